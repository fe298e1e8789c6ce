"""Composed pipelines. Each starts from the rows that pass the input check.

A pipeline is a DataFrame plan; those that read a small intermediate table in several branches write it while the plan
is built (their docstrings say so).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.exprs import NOT_FOUND_TEXT, just_under
from ledgerscope.operators.aggregates import agg_customer, agg_customer_features, top_customers
from ledgerscope.operators.consensus import compute_consensus, evidence_counts
from ledgerscope.operators.decide import classify_risk, explain_template, flag_gate, recommend_action
from ledgerscope.operators.features import compute_features
from ledgerscope.operators.filters import Filters, filter_txn
from ledgerscope.operators.quality import split_valid
from ledgerscope.operators.scoring import minmax_scale, score_aggregation, score_threshold_flag
from ledgerscope.params import DEFAULT_PARAMS, Params


def customer_scores_minmax(features: DataFrame, col: str = "amount_max") -> DataFrame:
    """Customer feature table with a deterministic 0..1 score (min-max of one feature).

    Stands in for the forest score where an exact SQL check is wanted; the
    forest itself is ``ledgerscope.operators.forest``.
    """
    return minmax_scale(agg_customer_features(features), col)


def model_evidence(txn: DataFrame, ml_hits: DataFrame) -> DataFrame:
    """Model evidence: every transaction of a flagged customer."""
    return txn.select("customer_id", "transaction_id").join(ml_hits.select("customer_id"), "customer_id", "left_semi")


def decide_consensus(consensus: DataFrame, evidence: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Gate -> risk -> action -> explanation over consensus rows."""
    g = flag_gate(consensus).join(evidence_counts(evidence), "customer_id", "left") \
        .withColumn("evidence_count", F.coalesce(F.col("evidence_count"), F.lit(0)))
    g = recommend_action(classify_risk(g, params))
    g = g.withColumn("confidence", F.round(F.least(F.lit(100.0), F.col("trust_score") + 5.0), 1))
    return explain_template(g, "evidence_count", "rule_total_amount")


Model = Callable[[DataFrame], DataFrame]


def minmax_model(customers: DataFrame) -> DataFrame:
    """A deterministic score (min-max of ``amount_max``): the surrogate of the registered fixture queries."""
    return minmax_scale(customers, "amount_max").select("customer_id", "score")


def flagship_items(txn: DataFrame, params: Params = DEFAULT_PARAMS, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, evidence) of features -> structuring -> model hits -> consensus -> gate -> risk -> action -> explanation.

    Quarantined rows are left out first. The rows are shuffled once (the feature windows, which also count the
    structuring window) and aggregated once per customer; rule hits, model scores, consensus and evidence counts are
    then computed on the customer table, which is written while the plan is built (an action).

    ``model``: from the customer table to (customer_id, score 0..1 and, if it has one, attribution), for instance
    ``lambda c: forest_scores(c, params)``; without it there is no model stage, and only rules flag.

    Evidence of an item is the distinct union of its rule evidence (just-under rows) and model evidence (all rows of
    the customer): (customer_id, transaction_id, amount), one more scan of narrow columns.
    """
    from ledgerscope.operators.structuring import structuring_from_customers
    from ledgerscope.schemas import ML_HIT
    from ledgerscope.session import cut_lineage

    clean, _ = split_valid(txn)
    feats = compute_features(clean, params, structuring_count=True)
    cf = cut_lineage(agg_customer_features(feats))  # one row per customer, read by every branch below
    hits = structuring_from_customers(cf, params)
    if model is None:
        ml = txn.sparkSession.createDataFrame([], ML_HIT).withColumn("top_features", F.array().cast("array<string>"))
        extra = ml.select("customer_id", "top_features", F.lit(None).cast("map<string,double>").alias("attribution"))
    else:
        scores = cut_lineage(model(cf))
        ml = score_threshold_flag(cf.join(scores.select("customer_id", "score"), "customer_id"), params)
        attribution = "attribution" if "attribution" in scores.columns else F.lit(None).cast("map<string,double>").alias("attribution")
        extra = ml.select("customer_id", "top_features").join(scores.select("customer_id", attribution), "customer_id")
    counts = cf.select("customer_id", "n_txn", "n_just_under")
    cons = (compute_consensus(hits, ml).join(extra, "customer_id", "left").join(counts, "customer_id", "left")
            .withColumn("evidence_count", F.when(F.col("has_ml"), F.col("n_txn"))
                        .when(F.col("has_rule"), F.col("n_just_under")).otherwise(F.lit(0))))
    g = recommend_action(classify_risk(flag_gate(cons), params))
    g = g.withColumn("confidence", F.round(F.least(F.lit(100.0), F.col("trust_score") + 5.0), 1))
    items = cut_lineage(explain_template(g, "evidence_count", "rule_total_amount").select(
        "customer_id", "agreement", "verdict", "pattern_matched", "rule_score", "ml_score",
        "risk_score", "risk_level", "recommended_action", "confidence", "trust_score",
        "evidence_count", F.array_join("top_features", ",").alias("top_features"), "explanation", "attribution", "has_ml"))
    rows = clean.select("customer_id", "transaction_id", "amount")
    evidence = (rows.join(items.select("customer_id", "has_ml"), "customer_id")
                .filter(F.col("has_ml") | just_under(F.col("amount"), params)).select("customer_id", "transaction_id", "amount"))
    return items.drop("has_ml"), evidence


def flagship_structuring(txn: DataFrame, params: Params = DEFAULT_PARAMS, model: Model | None = None) -> DataFrame:
    """The items of ``flagship_items`` without the attribution map."""
    return flagship_items(txn, params, model)[0].drop("attribution")


def _aggregated(clean: DataFrame, filters: Filters, params: Params) -> DataFrame:
    agg = agg_customer(filter_txn(clean, filters, params), filters.min_transaction_count)
    return top_customers(agg, filters.limit) if filters.limit else agg


def pipeline_aggregation(txn: DataFrame, filters: Filters, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Filter -> per-customer aggregate -> score -> risk -> action -> explanation.

    Every customer that meets the filters is an item, unless the user asks for a top n (``filters.limit``).
    """
    s = score_aggregation(_aggregated(split_valid(txn)[0], filters, params)).withColumn("pattern_matched", F.lit("high_transaction_frequency"))
    s = recommend_action(classify_risk(s, params, score_col="risk_score_raw"))
    s = explain_template(s, "transaction_count", "total_amount")
    return s.select("customer_id", "transaction_count", F.round("total_amount", 2).alias("total_amount"),
                    F.col("transaction_count").alias("evidence_count"),
                    "risk_score", "risk_level", "recommended_action",
                    F.lit(85.0).alias("confidence"), F.lit(90.0).alias("trust_score"),
                    F.lit("aggregation_threshold_hit").alias("pattern_matched"), "explanation")


def evidence_aggregation(txn: DataFrame, filters: Filters, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Evidence rows (customer_id, transaction_id, amount) of ``pipeline_aggregation``: the filtered rows of its items."""
    clean = split_valid(txn)[0]
    rows = filter_txn(clean, filters, params).select("customer_id", "transaction_id", "amount")
    return rows.join(_aggregated(clean, filters, params).select("customer_id"), "customer_id", "left_semi")


def _requested_ids(requested: DataFrame) -> DataFrame:
    from ledgerscope.operators.filters import normalize_entity_id

    return requested.select(normalize_entity_id(F.col("customer_id")).alias("customer_id")).distinct()


def evidence_entity(txn: DataFrame, requested: DataFrame) -> DataFrame:
    """Evidence rows (customer_id, transaction_id, amount) of an entity lookup: every row of a requested customer."""
    rows = split_valid(txn)[0].select(F.upper("customer_id").alias("customer_id"), "transaction_id", "amount")
    return rows.join(_requested_ids(requested), "customer_id", "left_semi")


def lookup_entity(txn: DataFrame, requested: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Profile many requested customer ids in one job.

    Ids are normalised (upper, trim, ``CUST`` prefix for digits). Score: 10
    baseline; structuring hit -> max(score, rule score); largest amount above
    the large-amount limit -> tag and at least 75. Unknown ids: found = false, 0.
    Its evidence rows: ``evidence_entity``.
    """
    from ledgerscope.operators.aggregates import agg_entity_profile
    from ledgerscope.operators.structuring import structuring_for_customers

    req = _requested_ids(requested)
    rows = split_valid(txn)[0].withColumn("customer_id", F.upper("customer_id"))
    prof = agg_entity_profile(rows, req)
    st = structuring_for_customers(rows, req, params).select("customer_id", F.col("rule_score").alias("_rs"))
    j = req.join(prof, "customer_id", "left").join(st, "customer_id", "left")
    found = F.col("transactions_count").isNotNull()
    big = F.coalesce(F.col("max_amount") > params.large_amount, F.lit(False))
    score = F.when(~found, F.lit(0.0)).otherwise(
        F.greatest(F.coalesce(F.col("_rs"), F.lit(10.0)), F.lit(10.0),
                   F.when(big, F.lit(75.0)).otherwise(F.lit(0.0))))
    patterns = F.array_compact(F.array(F.when(F.col("_rs").isNotNull(), F.lit("structuring")),
                                       F.when(big, F.lit("high_single_transaction_amount"))))
    return j.select("customer_id", found.alias("found"),
                    F.coalesce("transactions_count", F.lit(0)).alias("transactions_count"),
                    "total_volume", "avg_amount", score.alias("entity_score"),
                    F.array_join(patterns, ",").alias("flagged_patterns"))


def pipeline_entity(txn: DataFrame, requested: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Lookup -> risk -> action -> explanation; unknown ids get the not-found item."""
    e = lookup_entity(txn, requested, params)
    pattern = F.when(F.col("flagged_patterns") == "", F.lit("entity_check")) \
        .otherwise(F.split("flagged_patterns", ",")[0])
    e = e.withColumn("pattern_matched", F.when(F.col("found"), pattern).otherwise(F.lit("entity_not_found")))
    e = recommend_action(classify_risk(e, params, score_col="entity_score"))
    e = explain_template(e, "transactions_count", "total_volume")
    nf = ~F.col("found")
    return e.select(
        "customer_id", "found", "pattern_matched",
        F.when(nf, F.lit(0.0)).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(nf, F.lit("Low")).otherwise(F.col("risk_level")).alias("risk_level"),
        F.when(nf, F.lit("monitor")).otherwise(F.col("recommended_action")).alias("recommended_action"),
        F.when(nf, F.lit(100.0)).otherwise(F.lit(90.0)).alias("confidence"),
        F.when(nf, F.lit(100.0)).otherwise(F.lit(85.0)).alias("trust_score"),
        F.col("transactions_count").alias("evidence_count"),
        F.when(nf, F.format_string(NOT_FOUND_TEXT, "customer_id"))
         .otherwise(F.col("explanation")).alias("explanation"))


FLAGGED_COLUMNS = ["customer_id", "pattern_matched", "risk_score", "risk_level", "recommended_action", "confidence",
                   "trust_score", "evidence_count", "explanation"]


#: Modes in the order of their precedence.
MODES = ["entity_lookup", "aggregation_rule", "consensus"]


def assemble_flagged(entity: DataFrame | None, aggregation: DataFrame | None, consensus: DataFrame | None,
                     precedence: bool = True) -> DataFrame:
    """Flagged items of the three modes in one table, tagged by mode.

    A customer that several modes report keeps the item of the first of them (entity lookup, aggregation,
    consensus); ``precedence=False`` keeps one item a mode.
    """
    parts = [df.select(F.lit(mode).alias("mode"), *FLAGGED_COLUMNS) for mode, df in zip(MODES, (entity, aggregation, consensus)) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not precedence:
        return out
    rank = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode"))
    best = out.groupBy("customer_id").agg(F.min_by(F.struct("mode", *FLAGGED_COLUMNS[1:]), rank).alias("_i"))
    return best.select("_i.mode", "customer_id", *[f"_i.{c}" for c in FLAGGED_COLUMNS[1:]])


def assemble_evidence(entity: DataFrame | None, aggregation: DataFrame | None, consensus: DataFrame | None) -> DataFrame:
    """Evidence rows of the three modes in one long table (mode, customer_id, transaction_id, amount)."""
    parts = [df.select(F.lit(mode).alias("mode"), "customer_id", "transaction_id", "amount")
             for mode, df in zip(MODES, (entity, aggregation, consensus)) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class RunResponse:
    """A whole run: items, their evidence rows, bias warnings, item checks, totals and the quarantined rows."""

    items: DataFrame
    evidence: DataFrame
    bias: DataFrame
    verification: DataFrame
    totals: DataFrame
    quarantined: DataFrame


def run_response(txn: DataFrame, params: Params = DEFAULT_PARAMS, model: Model | None = None, requested: DataFrame | None = None,
                 filters: Filters | None = None) -> RunResponse:
    """Input check, the three modes (entity lookup and aggregation if asked for), then audit and verification of all items.

    The items (one row a customer at most) are written while the plan is built: evidence, audit, checks and totals all read them.
    """
    from ledgerscope.operators.aggregates import agg_run_totals
    from ledgerscope.operators.decide import bias_audit, verify_results
    from ledgerscope.session import cut_lineage

    clean, quarantined = split_valid(txn)
    consensus, rows = flagship_items(txn, params, model)
    items = cut_lineage(assemble_flagged(pipeline_entity(txn, requested, params) if requested is not None else None,
                                         pipeline_aggregation(txn, filters, params) if filters is not None else None, consensus))
    # the items of a mode are its customers, so its rows need no join of their own with them
    narrow = ("customer_id", "transaction_id", "amount")
    evidence = assemble_evidence(clean.select(F.upper("customer_id").alias("customer_id"), *narrow[1:]) if requested is not None else None,
                                 filter_txn(clean, filters, params).select(*narrow) if filters is not None else None, rows)
    evidence = evidence.join(items.select("mode", "customer_id"), ["mode", "customer_id"], "left_semi")
    return RunResponse(items, evidence, bias_audit(items, clean), verify_results(items, evidence, params, keys=("mode", "customer_id")),
                       agg_run_totals(items, evidence, clean), quarantined)


def results_table(flagged: DataFrame) -> DataFrame:
    """Presentation projection of flagged items."""
    return flagged.select("customer_id",
                          F.format_string("%.1f", F.col("risk_score")).alias("risk_score"),
                          "risk_level", F.upper("recommended_action").alias("action"),
                          F.coalesce("pattern_matched", F.lit("N/A")).alias("pattern"),
                          F.format_string("%.1f", F.col("confidence")).alias("confidence"),
                          F.col("evidence_count").alias("evidence"))


def pipeline_pattern(txn: DataFrame, pattern: str = "structuring", params: Params = DEFAULT_PARAMS,
                     min_transfer: float | None = None) -> DataFrame:
    """Rule pipeline of a pattern query: rule -> consensus -> gate -> risk -> action -> explanation.

    ``pattern``: "structuring" (threshold rule on the rows; it needs no other
    feature) or "layering" (transfer chains; ``min_transfer`` filters
    transfers). No model stage, as in a pattern query; evidence of an item =
    its rule evidence.
    """
    from ledgerscope.operators.graph import build_transfer_graph, detect_layering, layering_evidence
    from ledgerscope.operators.structuring import detect_structuring, structuring_evidence
    from ledgerscope.schemas import ML_HIT

    txn = split_valid(txn)[0]
    if pattern == "layering":
        hits = detect_layering(build_transfer_graph(txn, min_transfer))
        evidence = layering_evidence(hits)
    else:
        hits = detect_structuring(txn, params)
        evidence = structuring_evidence(txn, hits, params)
    no_model = txn.sparkSession.createDataFrame([], ML_HIT)
    cons = compute_consensus(hits, no_model)
    out = decide_consensus(cons, evidence, params)
    return out.select("customer_id", "agreement", "verdict", "pattern_matched", "rule_score", "risk_score",
                      "risk_level", "recommended_action", "confidence", "trust_score", "evidence_count",
                      "explanation")
