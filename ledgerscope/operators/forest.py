"""Isolation forest over customer feature rows (Liu, Ting and Zhou, 2008).

Fit: each tree draws its sample by ranking rows on a hash of (customer, tree,
seed), so the sample does not depend on partitioning or row order. Only rows
whose hash falls below a cut-off of about 4 x sample / n are kept, so the
per-tree groups handed to ``applyInPandas`` are bounded (~4 x sample rows).
Each group builds one tree (numpy, seeded by tree id) and returns flat node
rows.

Score: the model has at most ``trees x (2 x sample - 1)`` nodes (100 x 511 by
default), a proven bound, so it is collected once and goes to the tasks with
the function; every partition of the customer table is scored in
``mapInPandas`` with vectorised numpy descents, in a pass that hands the
customer's other columns on. Anomaly score = 2^(-E[h(x)] / c(sample)).

Attribution: path-dependent Shapley values of E[h(x)] (``shapley``), made for
the rows asked for only; they sum to E[h(x)] less the forest's expected path.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.bounded import attach_global

from ledgerscope.operators.aggregates import FEATURE_VECTOR
from ledgerscope.operators.shapley import ForestShapley
from ledgerscope.params import DEFAULT_PARAMS, Params

EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()), T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("sample_size", T.IntegerType()),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _c_vec(sizes: np.ndarray) -> np.ndarray:
    return np.array([c_factor(float(s)) for s in sizes]) if sizes.size else sizes.astype(float)


def _build_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (node_id, feature, threshold, left, right, size); feature -1 marks a leaf."""
    nodes: list[list] = []
    stack = [(np.arange(x.shape[0]), 0, None)]
    while stack:
        idx, depth, parent = stack.pop()
        node_id = len(nodes)
        if parent is not None:
            nodes[parent[0]][3 if parent[1] == "L" else 4] = node_id
        sub = x[idx]
        lo, hi = (sub.min(axis=0), sub.max(axis=0)) if idx.size else (None, None)
        varying = np.flatnonzero(hi > lo) if idx.size > 1 else np.array([], dtype=int)
        if depth >= limit or idx.size <= 1 or varying.size == 0:
            nodes.append([node_id, -1, 0.0, -1, -1, int(idx.size)])
            continue
        f = int(rng.choice(varying))
        thr = float(rng.uniform(lo[f], hi[f]))
        nodes.append([node_id, f, thr, -1, -1, int(idx.size)])
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        stack.append((right, depth + 1, (node_id, "R")))
        stack.append((left, depth + 1, (node_id, "L")))
    return [tuple(n) for n in nodes]


def fit_forest(customers: DataFrame, features: list[str] | None = None, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Node table of the forest (a DataFrame; at most trees x (2 x sample - 1) rows).

    A customer's hash is a place on a circle, and tree k may draw from an arc of length 4 * sample / n that starts at
    k / trees: a customer yields a row only for the trees whose arc holds it (4 * sample * trees rows in all, for any
    number of customers). Within its arc a tree takes the ``sample`` smallest by a hash of its own.
    """
    feats = features or FEATURE_VECTOR
    psi, trees, seed = params.forest_sample, params.forest_trees, params.forest_seed
    n = customers.agg(F.count(F.lit(1)).alias("_n"))

    def share(*cols):
        return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))

    rows = customers.select("customer_id", *[F.col(c).cast("double").alias(c) for c in feats])
    arc = F.least(F.lit(1.0), F.lit(4.0 * psi) / F.col("_n"))
    place = share(F.col("customer_id"), F.lit(seed)) * F.lit(trees)
    first, last = F.floor(place - arc * F.lit(trees)) + 1, F.floor(place)
    sampled = (attach_global(rows, n)
               .withColumn("tree_id", F.explode(F.when(first <= last, F.sequence(first, last))))
               .withColumn("tree_id", F.pmod("tree_id", F.lit(trees)).cast("int"))
               .withColumn("_u", share(F.col("customer_id"), F.col("tree_id"), F.lit(seed))).drop("_n"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "customer_id"]).head(psi)
        tree_id = int(pdf["tree_id"].iloc[0])
        x = pdf[feats].to_numpy(dtype=float)
        limit = int(math.ceil(math.log2(max(len(pdf), 2))))
        rng = np.random.default_rng([seed, tree_id])
        nodes = _build_tree(x, rng, limit)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "left", "right", "size"])
        out.insert(0, "tree_id", tree_id)
        out["sample_size"] = len(pdf)
        return out.astype({"tree_id": "int32", "node_id": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int32", "sample_size": "int32"})

    return sampled.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)


def _model_arrays(nodes: list) -> list[dict]:
    by_tree: dict[int, list] = {}
    for r in nodes:
        by_tree.setdefault(int(r["tree_id"]), []).append(r)
    model = []
    for tid in sorted(by_tree):
        rows = sorted(by_tree[tid], key=lambda r: r["node_id"])
        model.append({
            "feature": np.array([r["feature"] for r in rows], dtype=np.int64),
            "threshold": np.array([r["threshold"] for r in rows], dtype=float),
            "left": np.array([r["left"] for r in rows], dtype=np.int64),
            "right": np.array([r["right"] for r in rows], dtype=np.int64),
            "size": np.array([r["size"] for r in rows], dtype=np.int64),
            "leaf_c": _c_vec(np.array([r["size"] for r in rows], dtype=float)),
            "psi": int(rows[0]["sample_size"]),
        })
    return model


def collect_forest(nodes: DataFrame, params: Params = DEFAULT_PARAMS) -> list[dict]:
    """The trees as arrays.

    The model is bounded by construction (trees x (2 x sample - 1) node rows, from the parameters); one row
    past that bound is fetched so an unexpected input can never pull an unbounded table to the driver.
    """
    bound = params.forest_trees * (2 * params.forest_sample - 1)
    rows = nodes.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"forest model exceeds its bound of {bound} nodes")
    return _model_arrays([r.asDict() for r in rows])


def path_lengths(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row; 0 without trees."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for t in trees:
        node, depth = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        while True:
            f = t["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[rows, np.where(inner, f, 0)] < t["threshold"][node]
            node = np.where(inner, np.where(go_left, t["left"][node], t["right"][node]), node)
            depth += inner
        total += depth + t["leaf_c"][node]
    return total / max(len(trees), 1)


def score_forest(customers: DataFrame, nodes: DataFrame | list[dict], features: list[str] | None = None,
                 params: Params = DEFAULT_PARAMS, keep: list[str] | None = None) -> DataFrame:
    """(customer_id, columns ``keep`` and features as doubles, raw_score, path_length) per customer.

    ``raw_score``: higher = more anomalous, 0 without trees. ``nodes``: the node table, or the model of ``collect_forest``.
    """
    feats = features or FEATURE_VECTOR
    trees = collect_forest(nodes, params) if isinstance(nodes, DataFrame) else nodes
    psi = (c_factor(trees[0]["psi"]) if trees else 0.0) or 1.0
    rows = customers.select("customer_id", *[c for c in keep or [] if c not in feats], *[F.col(c).cast("double").alias(c) for c in feats])
    schema = T.StructType([*rows.schema.fields, T.StructField("raw_score", T.DoubleType()), T.StructField("path_length", T.DoubleType())])

    def score(batches):
        for pdf in batches:
            h = path_lengths(trees, pdf[feats].to_numpy(dtype=float))
            yield pdf.assign(raw_score=np.power(2.0, -h / psi) if trees else 0.0, path_length=h)

    return rows.mapInPandas(score, schema)


def explain_forest(scored: DataFrame, nodes: DataFrame | list[dict], features: list[str] | None = None,
                   params: Params = DEFAULT_PARAMS, least_score: float | None = None) -> DataFrame:
    """All columns of ``scored`` plus ``shapley`` (feature -> signed part of the path length), ``attribution`` (their absolute
    values) and ``expected_path``: the parts sum to ``path_length - expected_path``.

    ``least_score``: rows whose ``score`` lies below it get nulls instead. The tables are built once a task that has rows.
    """
    feats = features or FEATURE_VECTOR
    trees = collect_forest(nodes, params) if isinstance(nodes, DataFrame) else nodes
    added = {"shapley": T.MapType(T.StringType(), T.DoubleType()), "attribution": T.MapType(T.StringType(), T.DoubleType()), "expected_path": T.DoubleType()}
    rows = scored.drop(*added)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def explain(batches):
        tables = None
        for pdf in batches:
            wanted = np.ones(len(pdf), bool) if least_score is None else pdf["score"].to_numpy(dtype=float) >= least_score
            signed = [None] * len(pdf)
            if wanted.any():
                tables = tables or ForestShapley(trees, len(feats))
                for i, v in zip(np.flatnonzero(wanted), tables.values(pdf.loc[wanted, feats].to_numpy(dtype=float))):
                    signed[i] = dict(zip(feats, map(float, v)))
            yield pdf.assign(shapley=signed, attribution=[s and {f: abs(v) for f, v in s.items()} for s in signed],
                             expected_path=np.where(wanted, tables.expected if tables else 0.0, np.nan))

    out = rows.mapInPandas(explain, schema)
    return out.withColumn("expected_path", F.nanvl("expected_path", F.lit(None).cast("double")))


def _scored(customer_features: DataFrame, params: Params, features: list[str] | None, keep: list[str]) -> tuple[DataFrame, list[dict]]:
    """(scored customers with ``score`` 0..1, written once since scaling reads them twice; the model)."""
    from ledgerscope.operators.scoring import minmax_scale
    from ledgerscope.session import cut_lineage

    trees = collect_forest(fit_forest(customer_features, features, params), params)
    return minmax_scale(cut_lineage(score_forest(customer_features, trees, features, params, keep)), "raw_score", "score"), trees


def forest_scores(customer_features: DataFrame, params: Params = DEFAULT_PARAMS,
                  features: list[str] | None = None) -> DataFrame:
    """(customer_id, score 0..1, attribution) of every customer: fit, score, min-max scale; attribution of the hits, else null."""
    scored, trees = _scored(customer_features, params, features, [])
    return explain_forest(scored, trees, features, params, params.ml_score_threshold).select("customer_id", "score", "attribution")


def detect_anomaly(customer_features: DataFrame, params: Params = DEFAULT_PARAMS,
                   features: list[str] | None = None) -> DataFrame:
    """Model hits: min-max normalised forest score >= threshold.

    Output: customer_id, ml_score (3 dp), anomaly_flag, top_features, attribution, enough_customers (false when
    fewer than ``ml_min_customers`` were scored; no hit is dropped for it). The scoring pass hands on the columns
    that the tags need, and only the hits are explained.
    """
    from ledgerscope.operators.scoring import feature_tags
    from ledgerscope.session import cut_lineage

    tagged = ["max_zscore", "max_rolling_7d_count", "amount_max"]
    # the fit and the scoring pass read the customer table: materialise it once
    cols = ["customer_id", *(features or FEATURE_VECTOR)]
    cf = cut_lineage(customer_features.select(*cols, *[c for c in tagged if c not in cols]))
    scored, trees = _scored(cf, params, features, tagged)
    n = scored.agg(F.count(F.lit(1)).alias("_n"))
    hits = explain_forest(attach_global(scored, n).filter(F.col("score") >= params.ml_score_threshold), trees, features, params)
    return hits.select("customer_id", F.round("score", 3).alias("ml_score"), F.lit(True).alias("anomaly_flag"),
                       feature_tags(hits, params).alias("top_features"), "attribution",
                       (F.col("_n") >= params.ml_min_customers).alias("enough_customers"))


def rank_attribution(hits: DataFrame) -> DataFrame:
    """Features of each hit ranked by contribution (explode of the attribution map)."""
    from pyspark.sql import Window
    e = hits.select("customer_id", F.explode("attribution").alias("feature", "contribution"))
    w = Window.partitionBy("customer_id").orderBy(F.col("contribution").desc(), F.col("feature"))
    return e.withColumn("rank", F.row_number().over(w))
