"""Registered queries: features, structuring, consensus, decisions, flagship, aggregation pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators.consensus import compute_consensus, consensus_evidence
from ledgerscope.operators.decide import classify_risk, explain_template, flag_gate, recommend_action
from ledgerscope.operators.features import compute_features
from ledgerscope.operators.filters import Filters
from ledgerscope.operators.scoring import score_threshold_flag
from ledgerscope.operators.structuring import detect_structuring, structuring_evidence
from ledgerscope.params import Params
from ledgerscope.plans.pipelines import (customer_scores_minmax, flagship_structuring, minmax_model, model_evidence,
                                         pipeline_aggregation)
from ledgerscope.plans.registry import register
from ledgerscope.plans.sqlparts import (CONSENSUS_CTE, CUSTOMER_FEATURES_CTE, MINMAX_ML_CTE, action_sql,
                                        explanation_sql, risk_level_sql, risk_score_sql, tags_sql)
from ledgerscope.plans.sqlviews import FEATURES_CTE, STRUCTURING_CTE, TXN_CTE, structuring_subs, with_ctes
from ledgerscope.sources.tables import txn_view

# Operator arguments of the fixture queries (FIXTURES.md): a wider just-under band
# so that structuring fires on the driver tables. Defaults stay as in Params.
FIX = Params(structuring_lower_bound=8000.0, structuring_threshold=12000.0)
SUBS = structuring_subs(FIX)
ML_SUBS = {"tags": tags_sql(FIX), "thr": FIX.ml_score_threshold}


def _feature_select(df):
    return df.select("transaction_id", "customer_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                     F.col("amount").cast("double").alias("amount"), "is_just_under_threshold",
                     F.round("amount_zscore_vs_customer_avg", 4).alias("amount_zscore_vs_customer_avg"),
                     F.round("velocity_hours_since_last_txn", 4).alias("velocity_hours_since_last_txn"),
                     "rolling_7d_count", F.round("rolling_30d_sum", 2).alias("rolling_30d_sum"))


FEATURE_SELECT_SQL = """SELECT transaction_id, customer_id, CAST(timestamp AS TIMESTAMP) AS timestamp,
  CAST(amount AS DOUBLE) AS amount, is_just_under_threshold,
  round(amount_zscore_vs_customer_avg, 4) AS amount_zscore_vs_customer_avg,
  round(velocity_hours_since_last_txn, 4) AS velocity_hours_since_last_txn,
  rolling_7d_count, round(rolling_30d_sum, 2) AS rolling_30d_sum FROM feat"""


@register("compute_features", with_ctes(FEATURE_SELECT_SQL, TXN_CTE, FEATURES_CTE, **SUBS))
def q_compute_features(spark, sf):
    return _feature_select(compute_features(txn_view(spark, sf), FIX))


@register("detect_structuring", with_ctes("SELECT * FROM hits", TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_detect_structuring(spark, sf):
    return detect_structuring(txn_view(spark, sf), FIX)


@register("structuring_evidence", with_ctes(
    "SELECT customer_id, transaction_id FROM ju WHERE customer_id IN (SELECT customer_id FROM hits)",
    TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_structuring_evidence(spark, sf):
    txn = txn_view(spark, sf)
    return structuring_evidence(txn, detect_structuring(txn, FIX), FIX)


def _consensus(spark, sf):
    txn = txn_view(spark, sf)
    feats = compute_features(txn, FIX)
    hits = detect_structuring(txn, FIX)
    ml = score_threshold_flag(customer_scores_minmax(feats), FIX)
    return txn, hits, ml, compute_consensus(hits, ml)


CONS_SQL_CTES = (TXN_CTE, FEATURES_CTE, STRUCTURING_CTE, CUSTOMER_FEATURES_CTE, MINMAX_ML_CTE,
                 CONSENSUS_CTE)
CONS_SUBS = {**SUBS, **ML_SUBS, "rules": "hits"}


@register("score_threshold_flag", with_ctes(
    "SELECT customer_id, ml_score, true AS anomaly_flag, top_features, (SELECT count(*) FROM sc) >= 5 AS enough_customers FROM ml",
    TXN_CTE, FEATURES_CTE, CUSTOMER_FEATURES_CTE, MINMAX_ML_CTE, **SUBS, **ML_SUBS))
def q_score_threshold_flag(spark, sf):
    feats = compute_features(txn_view(spark, sf), FIX)
    ml = score_threshold_flag(customer_scores_minmax(feats), FIX)
    return ml.withColumn("top_features", F.array_join("top_features", ","))


@register("compute_consensus", with_ctes(
    "SELECT customer_id, agreement, rule_score, ml_score, combined_score, trust_score, verdict, pattern_matched "
    "FROM cons2", *CONS_SQL_CTES, **CONS_SUBS))
def q_compute_consensus(spark, sf):
    return _consensus(spark, sf)[3].select("customer_id", "agreement", "rule_score", "ml_score", "combined_score",
                                           "trust_score", "verdict", "pattern_matched")


@register("evidence_union", with_ctes(
    "SELECT customer_id, transaction_id FROM ju WHERE customer_id IN (SELECT customer_id FROM hits) "
    "UNION SELECT customer_id, transaction_id FROM txn WHERE customer_id IN (SELECT customer_id FROM ml)",
    *CONS_SQL_CTES, **CONS_SUBS))
def q_evidence_union(spark, sf):
    txn, hits, ml, _ = _consensus(spark, sf)
    return consensus_evidence(structuring_evidence(txn, hits, FIX), model_evidence(txn, ml))


@register("filter_flag_gate", with_ctes(
    "SELECT customer_id, verdict, combined_score FROM cons2 WHERE verdict <> 'Normal' OR combined_score > 30.0",
    *CONS_SQL_CTES, **CONS_SUBS))
def q_filter_flag_gate(spark, sf):
    return flag_gate(_consensus(spark, sf)[3]).select("customer_id", "verdict", "combined_score")


@register("classify_risk", with_ctes(
    f"SELECT customer_id, {risk_score_sql('combined_score', 'pattern_matched')} AS risk_score, "
    f"{risk_level_sql('combined_score', 'pattern_matched')} AS risk_level FROM cons2",
    *CONS_SQL_CTES, **CONS_SUBS))
def q_classify_risk(spark, sf):
    return classify_risk(_consensus(spark, sf)[3], FIX).select("customer_id", "risk_score", "risk_level")


@register("recommend_action", with_ctes(
    f"SELECT customer_id, {risk_level_sql('combined_score', 'pattern_matched')} AS risk_level, "
    f"{action_sql(risk_level_sql('combined_score', 'pattern_matched'))} AS recommended_action FROM cons2",
    *CONS_SQL_CTES, **CONS_SUBS))
def q_recommend_action(spark, sf):
    return recommend_action(classify_risk(_consensus(spark, sf)[3], FIX)) \
        .select("customer_id", "risk_level", "recommended_action")


FLAGSHIP_SELECT = f"""
, ev AS (SELECT customer_id, transaction_id FROM ju WHERE customer_id IN (SELECT customer_id FROM hits)
         UNION SELECT customer_id, transaction_id FROM txn WHERE customer_id IN (SELECT customer_id FROM ml)),
evc AS (SELECT customer_id, count(transaction_id) AS evidence_count FROM ev GROUP BY customer_id),
g AS (SELECT c.*, coalesce(e.evidence_count, 0) AS evidence_count,
             {risk_score_sql('c.combined_score', 'c.pattern_matched')} AS risk_score,
             {risk_level_sql('c.combined_score', 'c.pattern_matched')} AS risk_level
      FROM cons2 c LEFT JOIN evc e ON c.customer_id = e.customer_id
      WHERE c.verdict <> 'Normal' OR c.combined_score > 30.0)
SELECT customer_id, agreement, verdict, pattern_matched, rule_score, ml_score, risk_score, risk_level,
       {action_sql('risk_level')} AS recommended_action,
       round(least(100.0, trust_score + 5.0), 1) AS confidence, trust_score, evidence_count, top_features,
       {explanation_sql('customer_id', 'pattern_matched', 'risk_level', 'evidence_count', 'rule_total_amount')}
         AS explanation
FROM g"""


def _flagship_sql():
    s = with_ctes("SELECT 1", *CONS_SQL_CTES, **CONS_SUBS)
    return s[: -len("SELECT 1")].rstrip() + FLAGSHIP_SELECT


@register("flagship_structuring", _flagship_sql())
def q_flagship(spark, sf):
    return flagship_structuring(txn_view(spark, sf), FIX, minmax_model)


@register("explain_template", _flagship_sql().replace(
    "SELECT customer_id, agreement, verdict, pattern_matched, rule_score, ml_score, risk_score, risk_level,",
    "SELECT customer_id, explanation FROM (SELECT customer_id, agreement, verdict, pattern_matched, rule_score, "
    "ml_score, risk_score, risk_level,") + ") x")
def q_explain(spark, sf):
    return flagship_structuring(txn_view(spark, sf), FIX, minmax_model).select("customer_id", "explanation")


AGG_FILTERS = Filters(amount_threshold=10000.0, min_transaction_count=10)


AGG_CTES = (TXN_CTE, """a AS (
  SELECT customer_id, count(transaction_id) AS transaction_count, CAST(sum(amount) AS DOUBLE) AS total_amount
  FROM txn WHERE amount < 10000.0 GROUP BY customer_id HAVING count(transaction_id) >= 10
)""",
  "s AS (SELECT *, least(95.0, 40.0 + 4.0 * transaction_count) AS raw FROM a)")
_AGG_LVL = risk_level_sql('raw', "'high_transaction_frequency'")


@register("pipeline_aggregation", with_ctes(f"""SELECT customer_id, transaction_count, transaction_count AS evidence_count,
  round(total_amount, 2) AS total_amount,
  {risk_score_sql('raw', "'high_transaction_frequency'")} AS risk_score, {_AGG_LVL} AS risk_level,
  {action_sql(_AGG_LVL)} AS recommended_action,
  85.0 AS confidence, 90.0 AS trust_score, 'aggregation_threshold_hit' AS pattern_matched,
  {explanation_sql('customer_id', "'high_transaction_frequency'", _AGG_LVL, 'transaction_count', 'total_amount')}
    AS explanation FROM s""", *AGG_CTES))
def q_pipeline_aggregation(spark, sf):
    return pipeline_aggregation(txn_view(spark, sf), AGG_FILTERS, FIX)


def _pattern_structuring_sql():
    lvl = risk_level_sql("greatest(rule_score, 75.0)", "'structuring'")
    return with_ctes(f"""SELECT customer_id, 'Partial' AS agreement, 'Rule Violation' AS verdict,
  'structuring' AS pattern_matched, rule_score,
  {risk_score_sql('greatest(rule_score, 75.0)', "'structuring'")} AS risk_score, {lvl} AS risk_level,
  {action_sql(lvl)} AS recommended_action, 85.0 AS confidence, 80.0 AS trust_score, txn_count AS evidence_count,
  {explanation_sql('customer_id', "'structuring'", lvl, 'txn_count', 'total_amount')} AS explanation FROM hits""",
                     TXN_CTE, STRUCTURING_CTE, **SUBS)


@register("pipeline_structuring_rules", _pattern_structuring_sql())
def q_pipeline_structuring_rules(spark, sf):
    """Pattern query for structuring without a model stage: rule -> consensus -> risk -> action -> explanation."""
    from ledgerscope.plans.pipelines import pipeline_pattern
    return pipeline_pattern(txn_view(spark, sf), "structuring", FIX)
