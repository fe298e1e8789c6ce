"""Transfer graph: edges between customers, layering chains and closed cycles.

Everything is an equi-join on edge tables, and no result lists paths: rows are
per customer, or per edge and hop. A customer starts a chain of two transfers
iff one of its receivers sends to someone other than the customer, which a
per-node summary (two smallest receivers) decides with one join.
``least_chains`` extends that chain by the least next receiver;
``enumerate_chains``, ``hop_summary`` and ``detect_cycles`` use ``paths``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.operators.filters import filter_transfers
from ledgerscope.operators.paths import chain_relation, least_cycles, path_counts
from ledgerscope.session import cut_lineage


def account_owners(txn: DataFrame) -> DataFrame:
    """account_id -> customer_id; the latest row (time, id) wins. Grouped, partial-aggregated."""
    return (txn.groupBy("account_id")
            .agg(F.max_by("customer_id", F.struct("timestamp", "transaction_id")).alias("owner")))


def build_transfer_graph(txn: DataFrame, min_amount: float | None = None) -> DataFrame:
    """Edges (src, dst, txn_id, amount) between distinct customers; parallel transfers keep the latest."""
    tr = filter_transfers(txn)
    if min_amount is not None:
        tr = tr.filter(F.col("amount") >= F.lit(min_amount))
    own = account_owners(txn)
    s_own = own.select(F.col("account_id").alias("_sa"), F.col("owner").alias("_so"))
    r_own = own.select(F.col("account_id").alias("_ra"), F.col("owner").alias("_ro"))
    j = (tr.join(s_own, tr.account_id == s_own._sa, "left")
           .join(r_own, tr.counterparty_id == r_own._ra, "left")
           .select(F.coalesce("_so", "account_id").alias("src"), F.coalesce("_ro", "counterparty_id").alias("dst"),
                   "transaction_id", "timestamp", "amount"))
    return (j.filter(F.col("src") != F.col("dst"))
            .groupBy("src", "dst")
            .agg(F.max_by(F.struct("transaction_id", "amount"), F.struct("timestamp", "transaction_id")).alias("_e"))
            .select("src", "dst", F.col("_e.transaction_id").alias("txn_id"),
                    F.col("_e.amount").cast("double").alias("amount")))


def node_summary(edges: DataFrame) -> DataFrame:
    """Per sender: out-degree and its two smallest receivers."""
    first = edges.groupBy("src").agg(F.count("dst").alias("out_degree"), F.min("dst").alias("r1"))
    second = (edges.join(first.select("src", "r1"), "src")
              .filter(F.col("dst") > F.col("r1")).groupBy("src").agg(F.min("dst").alias("r2")))
    return first.join(second, "src", "left")


def _least_chains(edges: DataFrame) -> DataFrame:
    """(a, b, c, t1, t2): for each originator the lexicographically least simple path of two transfers."""
    ns = node_summary(edges).select(F.col("src").alias("b"), "r1", "r2")
    cand = (edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
            .join(ns, "b")
            .withColumn("c", F.when(F.col("r1") != F.col("a"), F.col("r1")).otherwise(F.col("r2")))
            .filter(F.col("c").isNotNull()))
    best = cand.groupBy("a").agg(F.min(F.struct("b", "c")).alias("_p")).select("a", "_p.b", "_p.c")
    e1 = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("txn_id").alias("t1"))
    e2 = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("txn_id").alias("t2"))
    return best.join(e1, ["a", "b"]).join(e2, ["b", "c"])


def detect_layering(edges: DataFrame, score: float = 85.0, materialize: bool = True) -> DataFrame:
    """Customers that start a simple path of two transfers; chain = lexicographically least such path.

    One row per originator: chain ``a->b->c``, the two evidence transaction ids, score.
    The edge table is read five times, so it is written once first (``materialize``; an action).
    """
    if materialize:
        edges = cut_lineage(edges)
    return _least_chains(edges).select(
        F.col("a").alias("customer_id"), F.lit("layering").alias("rule_fired"),
        F.concat_ws("->", "a", "b", "c").alias("chain"),
        F.concat_ws(",", "t1", "t2").alias("supporting_txn_ids"),
        F.lit(2).cast("long").alias("txn_count"), F.lit(None).cast("double").alias("total_amount"),
        F.lit(float(score)).alias("rule_score"))


def layering_evidence(hits: DataFrame) -> DataFrame:
    """Evidence rows (customer_id, transaction_id) of layering hits (two per hit)."""
    return hits.select("customer_id", F.explode(F.split("supporting_txn_ids", ",")).alias("transaction_id"))


def smallest_receivers(edges: DataFrame, n: int) -> DataFrame:
    """Per sender the ``n`` smallest receivers with their transactions, as an array of (dst, txn_id).

    Spark limits the rank window before the shuffle as well, so a hub costs ``n`` rows a task.
    """
    w = Window.partitionBy("src").orderBy("dst")
    few = edges.select("src", "dst", "txn_id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return few.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "txn_id"))).alias("receivers"))


def least_chains(edges: DataFrame, max_hops: int = 4, materialize: bool = True) -> DataFrame:
    """One chain per originator: its least path of two transfers, extended up to ``max_hops``.

    Each further hop goes to the least receiver that is not on the chain yet; a chain without one ends. A chain
    has at most ``max_hops`` nodes behind it, so the ``max_hops`` smallest receivers of a node decide its next hop:
    a hop is one join with at most one row a chain.
    """
    if materialize:
        edges = cut_lineage(edges)
    chains = _least_chains(edges).select(F.array("a", "b", "c").alias("nodes"), F.array("t1", "t2").alias("txns"))
    ends = smallest_receivers(edges, max_hops + 1).withColumnRenamed("src", "_last")
    for _ in range(3, max_hops + 1):
        step = chains.withColumn("_last", F.element_at("nodes", -1)).join(ends, "_last", "left")
        free = F.filter("receivers", lambda r: ~F.array_contains(F.col("nodes"), r["dst"]))
        step = step.withColumn("_next", F.when(F.size(free) > 0, free[0]))
        # a chain that has ended has no free receiver, then or later
        chains = step.select(F.when(F.col("_next").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("_next.dst"))).alias("nodes"),
                             F.when(F.col("_next").isNull(), F.col("txns")).otherwise(F.concat("txns", F.array("_next.txn_id"))).alias("txns"))
    return chains.select(F.col("nodes")[0].alias("originator"), F.element_at("nodes", -1).alias("target"),
                         F.size("txns").alias("hops"), F.array_join("nodes", "->").alias("chain"), F.array_join("txns", ",").alias("txn_ids"))


def enumerate_chains(edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """All simple paths of two to ``max_hops`` transfers, factorised: (hop, src, dst, txn_id, paths through the edge at that hop)."""
    return chain_relation(path_counts(edges), max_hops)


def hop_summary(edges: DataFrame) -> DataFrame:
    """Per originator: receivers, and the number of simple paths of two, three and four transfers that it starts."""
    paths = {"two": "n2_1", "three": "n3_1", "four": "n4_1"}
    return (path_counts(edges).groupBy(F.col("src").alias("customer_id"))
            .agg(F.count(F.lit(1)).alias("receivers"), *[F.sum(c).alias(f"{n}_hop_paths") for n, c in paths.items()]))


def detect_cycles(edges: DataFrame) -> DataFrame:
    """One row for every customer that is in a closed cycle of three or four: its least cycle, beginning with it.

    Least is the shorter length first, then the least members in order. See ``paths.least_cycles`` for the work.
    """
    return least_cycles(edges).select(
        F.col("node").alias("cycle_start"), "length", F.concat_ws("->", F.array_join("nodes", "->"), F.col("node")).alias("cycle"),
        F.array_join("txns", ",").alias("txn_ids"))


def distinct_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
