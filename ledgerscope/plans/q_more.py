"""Registered queries: filters, joins, aggregates, windows, sorts, sets, scalar functions, decisions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerscope.functions.exprs import NOT_FOUND_TEXT, currency_short, dollar_amounts, money, zero_padded
from ledgerscope.operators import aggregates as A
from ledgerscope.operators.decide import bias_audit, segment_shares, verification_status
from ledgerscope.operators.features import (compute_features, customer_amount_stats, daily_txn_count,
                                            rolling_features)
from ledgerscope.operators.filters import (Filters, extract_evidence_rows, filter_last_n_days, filter_txn,
                                           flag_just_under, label_ground_truth, normalize_entity_id)
from ledgerscope.operators.scoring import minmax_scale, score_aggregation, score_threshold_flag
from ledgerscope.operators.sets import (distinct_demographics, join_rule_ml_outer, semi_flagged,
                                        union_flagged_customers, union_rule_hits, unflagged_customers)
from ledgerscope.operators.structuring import (detect_structuring, structuring_evidence, structuring_for_customers,
                                               structuring_windows)
from ledgerscope.operators.graph import build_transfer_graph, detect_layering
from ledgerscope.plans.pipelines import (assemble_flagged, customer_scores_minmax, evidence_aggregation, evidence_entity,
                                         flagship_items, flagship_structuring, lookup_entity, minmax_model,
                                         pipeline_aggregation, pipeline_entity, results_table, run_response)
from ledgerscope.plans.q_core import (AGG_FILTERS, CONS_SQL_CTES, CONS_SUBS, FEATURE_SELECT_SQL, FIX, ML_SUBS,
                                      SUBS, _flagship_sql)
from ledgerscope.plans.q_graph import GRAPH_CTE
from ledgerscope.plans.registry import register
from ledgerscope.plans.sqlparts import CUSTOMER_FEATURES_CTE, MINMAX_ML_CTE, tags_sql
from ledgerscope.plans.sqlviews import (FEATURES_CTE, ORDERS_TXN_CTE, STRUCTURING_CTE, TXN_CTE, with_ctes)
from ledgerscope.sources.tables import feedback_view, orders_txn_view, table, txn_view

ROW_COLS = ["transaction_id", "customer_id", "amount"]
ROW_SQL = "SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount FROM txn"


def _rows(df):
    return df.select("transaction_id", "customer_id", F.col("amount").cast("double").alias("amount"))


def _txn_q(sql_where: str):
    return with_ctes(f"{ROW_SQL} WHERE {sql_where}", TXN_CTE)


# ---------------------------------------------------------------- 2.C filters
@register("filter_date_range", _txn_q("timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-13'"))
def q_filter_date_range(spark, sf):
    return _rows(filter_txn(txn_view(spark, sf), Filters(date_start=dt.date(2024, 1, 5), date_end=dt.date(2024, 1, 12))))


@register("filter_date_end_only", _txn_q(
    "timestamp >= TIMESTAMP '2023-10-22' AND timestamp <= TIMESTAMP '2024-01-21'"))
def q_filter_date_end_only(spark, sf):
    return _rows(filter_txn(txn_view(spark, sf), Filters(date_end=dt.date(2024, 1, 20))))


@register("filter_last_n_days", _txn_q("timestamp >= TIMESTAMP '2024-01-20' AND timestamp <= TIMESTAMP '2024-01-31'"))
def q_filter_last_n_days(spark, sf):
    return _rows(filter_last_n_days(txn_view(spark, sf), 10, dt.date(2024, 1, 30)))


@register("filter_country", _txn_q("lower(country) = lower('nation_2')"))
def q_filter_country(spark, sf):
    return _rows(filter_txn(txn_view(spark, sf), Filters(country="nation_2")))


@register("filter_txn_type", _txn_q("lower(transaction_type) LIKE '%deposit%'"))
def q_filter_txn_type(spark, sf):
    return _rows(filter_txn(txn_view(spark, sf), Filters(transaction_type="DEPOSIT")))


@register("filter_segment", _txn_q("lower(customer_segment) = 'building'"))
def q_filter_segment(spark, sf):
    return _rows(filter_txn(txn_view(spark, sf), Filters(customer_segment="Building")))


@register("filter_amount_below", _txn_q("amount < 10000.0"))
def q_filter_amount_below(spark, sf):
    return _rows(filter_txn(txn_view(spark, sf), Filters(amount_threshold=10000.0)))


@register("filter_combined", _txn_q(
    "timestamp >= TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-26' "
    "AND lower(transaction_type) LIKE '%transfer%' AND lower(customer_segment) = 'machinery' AND amount < 50000.0"))
def q_filter_combined(spark, sf):
    f = Filters(date_start=dt.date(2024, 1, 3), date_end=dt.date(2024, 1, 25), transaction_type="transfer",
                customer_segment="MACHINERY", amount_threshold=50000.0, country="")
    return _rows(filter_txn(txn_view(spark, sf), f))


@register("flag_just_under", with_ctes(
    "SELECT transaction_id, (amount >= 9000.0 AND amount < 10000.0) AS is_just_under_threshold FROM txn", TXN_CTE))
def q_flag_just_under(spark, sf):
    return flag_just_under(txn_view(spark, sf)).select("transaction_id", "is_just_under_threshold")


@register("normalize_entity_id", """SELECT raw, CASE WHEN NOT starts_with(upper(trim(raw)), 'CUST')
    AND regexp_matches(upper(trim(raw)), '^[0-9]+$') THEN 'CUST' || upper(trim(raw)) ELSE upper(trim(raw)) END AS customer_id
  FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN ' ' || CAST(doc_id AS VARCHAR) || ' '
                    WHEN doc_id % 3 = 1 THEN 'cust' || CAST(doc_id AS VARCHAR) ELSE 'x' || CAST(doc_id AS VARCHAR) END
          AS raw FROM labels)""")
def q_normalize_entity_id(spark, sf):
    lab = table(spark, sf, "labels")
    d = F.col("doc_id").cast("string")
    raw = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), d, F.lit(" ")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("cust"), d)).otherwise(F.concat(F.lit("x"), d)))
    return lab.select(raw.alias("raw")).select("raw", normalize_entity_id(F.col("raw")).alias("customer_id"))


@register("label_ground_truth", with_ctes(
    "SELECT transaction_id, CAST(coalesce((amount >= 9000.0 AND amount < 10000.0 AND transaction_type = 'cash_deposit')"
    " OR (amount > 50000.0 AND transaction_type = 'transfer'), false) AS INTEGER) AS is_laundering_ground_truth "
    "FROM txn", TXN_CTE))
def q_label_ground_truth(spark, sf):
    return label_ground_truth(txn_view(spark, sf)).select("transaction_id", "is_laundering_ground_truth")


@register("extract_evidence_rows", with_ctes(
    "SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount FROM txn "
    "WHERE transaction_id IN (SELECT transaction_id FROM ju WHERE customer_id IN (SELECT customer_id FROM hits))",
    TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_extract_evidence_rows(spark, sf):
    txn = txn_view(spark, sf)
    return _rows(extract_evidence_rows(txn, structuring_evidence(txn, detect_structuring(txn, FIX), FIX)))


# ---------------------------------------------------------------- 2.D joins
@register("join_customer_stats", with_ctes(
    "SELECT t.transaction_id, round(s.amount_mean, 4) AS amount_mean, round(s.amount_std, 4) AS amount_std "
    "FROM txn t LEFT JOIN stats s ON t.customer_id = s.customer_id",
    TXN_CTE, FEATURES_CTE.split(",\nfeat AS")[0], **SUBS))
def q_join_customer_stats(spark, sf):
    txn = txn_view(spark, sf)
    s = customer_amount_stats(txn)
    return (txn.join(s, "customer_id", "left")
            .select("transaction_id", F.round("amount_mean", 4).alias("amount_mean"),
                    F.round("amount_std", 4).alias("amount_std")))


@register("join_rule_ml_outer", with_ctes(
    "SELECT coalesce(h.customer_id, m.customer_id) AS customer_id, h.customer_id IS NOT NULL AS has_rule, "
    "m.customer_id IS NOT NULL AS has_ml, h.rule_score, m.ml_score FROM hits h FULL OUTER JOIN ml m "
    "ON h.customer_id = m.customer_id", *CONS_SQL_CTES, **CONS_SUBS))
def q_join_rule_ml_outer(spark, sf):
    txn = txn_view(spark, sf)
    ml = score_threshold_flag(customer_scores_minmax(compute_features(txn, FIX)), FIX)
    return join_rule_ml_outer(detect_structuring(txn, FIX), ml)


@register("semi_flagged", with_ctes(
    "SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, "
    "CASE WHEN customer_id IN (SELECT customer_id FROM hits) THEN 1 ELSE 0 END AS flagged FROM txn",
    TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_semi_flagged(spark, sf):
    txn = txn_view(spark, sf)
    return semi_flagged(_rows(txn), detect_structuring(txn, FIX))


@register("anti_skipped", with_ctes(
    "SELECT DISTINCT customer_id FROM txn WHERE customer_id NOT IN (SELECT customer_id FROM hits)",
    TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_anti_skipped(spark, sf):
    txn = txn_view(spark, sf)
    return unflagged_customers(txn, detect_structuring(txn, FIX))


@register("cross_minmax", with_ctes(
    "SELECT customer_id, round(CASE WHEN mx > mn THEN (amount_sum - mn) / (mx - mn) ELSE 0.0 END, 6) AS score "
    "FROM cf, (SELECT min(amount_sum) AS mn, max(amount_sum) AS mx FROM cf) m",
    TXN_CTE, FEATURES_CTE, CUSTOMER_FEATURES_CTE, **SUBS))
def q_cross_minmax(spark, sf):
    cf = A.agg_customer_features(compute_features(txn_view(spark, sf), FIX))
    return minmax_scale(cf, "amount_sum").select("customer_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- 2.E aggregates
@register("agg_customer", with_ctes(
    "SELECT customer_id, count(transaction_id) AS transaction_count, round(CAST(sum(amount) AS DOUBLE), 2) AS "
    "total_amount, round(avg(CAST(amount AS DOUBLE)), 4) AS avg_amount FROM txn GROUP BY customer_id "
    "HAVING count(transaction_id) >= 60", TXN_CTE))
def q_agg_customer(spark, sf):
    a = A.agg_customer(txn_view(spark, sf), 60)
    return a.select("customer_id", "transaction_count", F.round("total_amount", 2).alias("total_amount"),
                    F.round("avg_amount", 4).alias("avg_amount"))


@register("agg_summary", with_ctes(
    "SELECT count(*) AS total_transactions, round(CAST(sum(amount) AS DOUBLE), 2) AS total_volume, "
    "round(avg(CAST(amount AS DOUBLE)), 2) AS mean_amount, round(median(CAST(amount AS DOUBLE)), 2) AS median_amount "
    "FROM txn", TXN_CTE))
def q_agg_summary(spark, sf):
    return A.agg_summary(txn_view(spark, sf))


@register("agg_summary_empty", with_ctes(
    "SELECT count(*) AS total_transactions, coalesce(round(CAST(sum(amount) AS DOUBLE), 2), 0.0) AS total_volume, "
    "coalesce(round(avg(CAST(amount AS DOUBLE)), 2), 0.0) AS mean_amount, "
    "coalesce(round(median(CAST(amount AS DOUBLE)), 2), 0.0) AS median_amount FROM txn WHERE amount < 0", TXN_CTE))
def q_agg_summary_empty(spark, sf):
    return A.agg_summary(txn_view(spark, sf).filter(F.col("amount") < 0))


@register("agg_type_counts", with_ctes(
    "SELECT transaction_type, count(*) AS n FROM txn WHERE transaction_type IS NOT NULL GROUP BY 1", TXN_CTE))
def q_agg_type_counts(spark, sf):
    return A.agg_type_counts(txn_view(spark, sf))


@register("agg_daily", with_ctes(
    "SELECT CAST(timestamp AS DATE) AS date, round(CAST(sum(amount) AS DOUBLE), 2) AS amount, "
    "count(*) AS transaction_count FROM txn GROUP BY 1", TXN_CTE))
def q_agg_daily(spark, sf):
    return A.agg_daily(txn_view(spark, sf)).withColumn("amount", F.round("amount", 2))


@register("agg_histogram", with_ctes("""SELECT b.bin, round(m.lo + b.bin * (m.hi - m.lo) / 30, 4) AS bin_start,
  round(m.lo + (b.bin + 1) * (m.hi - m.lo) / 30, 4) AS bin_end, coalesce(c.n, 0) AS n
FROM m, (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS bin) b
LEFT JOIN (SELECT CAST(CASE WHEN m.hi = m.lo THEN 0 ELSE least(floor((CAST(t.amount AS DOUBLE) - m.lo)
            / ((m.hi - m.lo) / 30)), 29) END AS INTEGER) AS bin, count(*) AS n FROM txn t, m GROUP BY 1) c
  ON c.bin = b.bin""", TXN_CTE, "m AS (SELECT min(CAST(amount AS DOUBLE)) AS lo, max(CAST(amount AS DOUBLE)) AS hi FROM txn)"))
def q_agg_histogram(spark, sf):
    h = A.agg_histogram(txn_view(spark, sf), 30)
    return h.select("bin", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"), "n")


@register("agg_risk_breakdown", "SELECT risk_level, count(*) AS n FROM (" + _flagship_sql() + ") f GROUP BY 1")
def q_agg_risk_breakdown(spark, sf):
    return A.agg_risk_breakdown(flagship_structuring(txn_view(spark, sf), FIX, minmax_model))


@register("agg_kpis", with_ctes(
    "SELECT count(*) AS total_transactions, round(CAST(sum(amount) AS DOUBLE), 2) AS total_volume, "
    "round(avg(CAST(amount AS DOUBLE)), 4) AS avg_amount, count(DISTINCT customer_id) AS unique_customers FROM txn",
    TXN_CTE))
def q_agg_kpis(spark, sf):
    k = A.agg_kpis(txn_view(spark, sf))
    return k.select("total_transactions", F.round("total_volume", 2).alias("total_volume"),
                    F.round("avg_amount", 4).alias("avg_amount"), "unique_customers")


@register("agg_customer_stats", with_ctes(
    "SELECT customer_id, round(amount_mean, 4) AS amount_mean, round(amount_std, 4) AS amount_std FROM stats",
    TXN_CTE, FEATURES_CTE.split(",\nfeat AS")[0], **SUBS))
def q_agg_customer_stats(spark, sf):
    s = customer_amount_stats(txn_view(spark, sf))
    return s.select("customer_id", F.round("amount_mean", 4).alias("amount_mean"),
                    F.round("amount_std", 4).alias("amount_std"))


_CF_COLS = ["amount_mean", "amount_max", "amount_sum", "max_rolling_7d_count", "max_rolling_30d_sum", "max_zscore",
            "min_velocity_hours"]


@register("agg_customer_features", with_ctes(
    "SELECT customer_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in _CF_COLS) + ", n_txn FROM cf",
    TXN_CTE, FEATURES_CTE, CUSTOMER_FEATURES_CTE, **SUBS))
def q_agg_customer_features(spark, sf):
    cf = A.agg_customer_features(compute_features(txn_view(spark, sf), FIX))
    return cf.select("customer_id", *[F.round(c, 4).alias(c) for c in _CF_COLS], "n_txn")


_REQ_SQL = "SELECT DISTINCT 'CUST' || printf('%05d', doc_id) AS customer_id FROM labels"


def _requested(spark, sf):
    return feedback_view(spark, sf).select("customer_id").distinct()


@register("agg_entity_profile", with_ctes(
    "SELECT customer_id, count(transaction_id) AS transactions_count, round(CAST(sum(amount) AS DOUBLE), 2) AS "
    "total_volume, round(avg(CAST(amount AS DOUBLE)), 2) AS avg_amount, max(CAST(amount AS DOUBLE)) AS max_amount "
    f"FROM txn WHERE customer_id IN ({_REQ_SQL}) GROUP BY customer_id", TXN_CTE))
def q_agg_entity_profile(spark, sf):
    return A.agg_entity_profile(txn_view(spark, sf), _requested(spark, sf))


_FB_SQL = "SELECT CASE WHEN quality = 1 THEN 'True Positive' ELSE 'False Positive' END AS feedback FROM labels"


@register("agg_feedback", f"""SELECT count(*) FILTER (WHERE feedback = 'True Positive') AS true_positives,
  count(*) FILTER (WHERE feedback = 'False Positive') AS false_positives,
  count(*) FILTER (WHERE feedback IN ('True Positive', 'False Positive')) AS total,
  CASE WHEN count(*) FILTER (WHERE feedback IN ('True Positive', 'False Positive')) > 0
       THEN round(count(*) FILTER (WHERE feedback = 'False Positive') /
            count(*) FILTER (WHERE feedback IN ('True Positive', 'False Positive')), 6) END AS fp_ratio
  FROM ({_FB_SQL}) f""")
def q_agg_feedback(spark, sf):
    return A.agg_feedback(feedback_view(spark, sf)).withColumn("fp_ratio", F.round("fp_ratio", 6))


_SHARES_SQL = """
, demo AS (SELECT DISTINCT customer_id, country, customer_segment FROM txn),
fl AS (SELECT DISTINCT customer_id FROM hits),
pairs AS (
  SELECT 'country' AS dimension, country AS "group", customer_id FROM demo WHERE country IS NOT NULL
  UNION ALL SELECT 'customer_segment', customer_segment, customer_id FROM demo WHERE customer_segment IS NOT NULL),
pg AS (SELECT dimension, "group", count(*) AS population,
              count(*) FILTER (WHERE customer_id IN (SELECT customer_id FROM fl)) AS flagged FROM pairs GROUP BY 1, 2),
sh AS (SELECT pg.*, population / (SELECT count(*) FROM demo) AS pop_share,
              CASE WHEN (SELECT count(*) FROM fl) > 0 THEN flagged / (SELECT count(*) FROM fl) ELSE 0.0 END
                AS flag_share, (SELECT count(*) FROM demo) AS n_pop, (SELECT count(*) FROM fl) AS n_fl FROM pg)"""


def _shares_sql(select):
    s = with_ctes("SELECT 1", TXN_CTE, STRUCTURING_CTE, **SUBS)
    return s[: -len("SELECT 1")].rstrip() + _SHARES_SQL + "\n" + select


@register("agg_segment_share", _shares_sql(
    'SELECT dimension, "group", population, flagged, round(pop_share, 6) AS pop_share, '
    'round(flag_share, 6) AS flag_share FROM sh'))
def q_agg_segment_share(spark, sf):
    txn = txn_view(spark, sf)
    s = segment_shares(detect_structuring(txn, FIX), txn)
    return s.select("dimension", "group", "population", "flagged", F.round("pop_share", 6).alias("pop_share"),
                    F.round("flag_share", 6).alias("flag_share"))


@register("bias_audit", _shares_sql(
    'SELECT dimension, "group", floor((2000 * population + n_pop) // (2 * n_pop)) / 10.0 AS population_share, '
    'floor((2000 * flagged + n_fl) // (2 * n_fl)) / 10.0 AS flagged_share, '
    'floor((200 * flagged * n_pop + n_fl * population) // (2 * n_fl * population)) / 100.0 AS ratio '
    'FROM sh WHERE pop_share > 0.02 AND flag_share > 1.5 * pop_share'))
def q_bias_audit(spark, sf):
    txn = txn_view(spark, sf)
    return bias_audit(detect_structuring(txn, FIX), txn, min_pop_share=0.02, ratio=1.5)


@register("bias_audit_default", _shares_sql(
    'SELECT dimension, "group", floor((2000 * population + n_pop) // (2 * n_pop)) / 10.0 AS population_share, '
    'floor((2000 * flagged + n_fl) // (2 * n_fl)) / 10.0 AS flagged_share, '
    'floor((200 * flagged * n_pop + n_fl * population) // (2 * n_fl * population)) / 100.0 AS ratio '
    'FROM sh WHERE pop_share > 0.05 AND flag_share > 2.0 * pop_share'))
def q_bias_audit_default(spark, sf):
    txn = txn_view(spark, sf)
    return bias_audit(detect_structuring(txn, FIX), txn)


_PRED_SQL = """SELECT CAST(coalesce((amount >= 9000.0 AND amount < 10000.0 AND transaction_type = 'cash_deposit')
    OR (amount > 50000.0 AND transaction_type = 'transfer'), false) AS INTEGER) AS label,
  CASE WHEN amount >= 8000.0 THEN 1 ELSE 0 END AS prediction FROM txn"""


def _pred(spark, sf):
    t = label_ground_truth(txn_view(spark, sf))
    return t.select(F.col("is_laundering_ground_truth").alias("label"),
                    F.when(F.col("amount") >= 8000.0, 1).otherwise(0).alias("prediction"))


@register("agg_confusion", with_ctes(
    "SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, "
    "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0)"
    " AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM p", TXN_CTE, f"p AS ({_PRED_SQL})"))
def q_agg_confusion(spark, sf):
    return A.agg_confusion(_pred(spark, sf))


@register("eval_binary", with_ctes("""SELECT tn, fp, fn, tp, round(pr, 3) AS precision, round(rc, 3) AS recall,
  round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 3) AS f1_score, tp + fn AS positives,
  tn + fp + fn + tp AS total_samples
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)""", TXN_CTE, f"p AS ({_PRED_SQL})",
    "c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND "
    "prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE "
    "label = 1 AND prediction = 1) AS tp FROM p)"))
def q_eval_binary(spark, sf):
    return A.eval_binary(_pred(spark, sf))


@register("agg_run_totals", with_ctes("""SELECT (SELECT count(DISTINCT customer_id) FROM hits) AS flagged_entities,
  (SELECT count(DISTINCT transaction_id) FROM ju WHERE customer_id IN (SELECT customer_id FROM hits)) AS evidence_ids,
  (SELECT count(*) FROM txn) AS scanned_rows, (SELECT count(DISTINCT customer_id) FROM txn) AS evaluated_customers""",
    TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_agg_run_totals(spark, sf):
    txn = txn_view(spark, sf)
    hits = detect_structuring(txn, FIX)
    return A.agg_run_totals(hits, structuring_evidence(txn, hits, FIX), txn)


@register("agg_run_flagged_ids", with_ctes("SELECT DISTINCT customer_id FROM hits", TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_agg_run_flagged_ids(spark, sf):
    return A.flagged_ids(detect_structuring(txn_view(spark, sf), FIX))


# ---------------------------------------------------------------- 2.F windows
@register("win_velocity", with_ctes(
    "SELECT transaction_id, round(velocity_hours_since_last_txn, 4) AS velocity_hours_since_last_txn FROM feat",
    TXN_CTE, FEATURES_CTE, **SUBS))
def q_win_velocity(spark, sf):
    f = compute_features(txn_view(spark, sf), FIX)
    return f.select("transaction_id", F.round("velocity_hours_since_last_txn", 4).alias("velocity_hours_since_last_txn"))


@register("win_rolling_7d_count", with_ctes("SELECT transaction_id, rolling_7d_count FROM feat",
                                            TXN_CTE, FEATURES_CTE, **SUBS))
def q_win_rolling_7d_count(spark, sf):
    return compute_features(txn_view(spark, sf), FIX).select("transaction_id", "rolling_7d_count")


@register("win_rolling_30d_sum", with_ctes("SELECT transaction_id, round(rolling_30d_sum, 2) AS rolling_30d_sum FROM feat",
                                           TXN_CTE, FEATURES_CTE, **SUBS))
def q_win_rolling_30d_sum(spark, sf):
    f = compute_features(txn_view(spark, sf), FIX)
    return f.select("transaction_id", F.round("rolling_30d_sum", 2).alias("rolling_30d_sum"))


@register("win_zscore", with_ctes(
    "SELECT transaction_id, round(amount_zscore_vs_customer_avg, 4) AS amount_zscore_vs_customer_avg FROM feat",
    TXN_CTE, FEATURES_CTE, **SUBS))
def q_win_zscore(spark, sf):
    f = compute_features(txn_view(spark, sf), FIX)
    return f.select("transaction_id", F.round("amount_zscore_vs_customer_avg", 4).alias("amount_zscore_vs_customer_avg"))


@register("features_orders_ties", with_ctes(FEATURE_SELECT_SQL,
                                            ORDERS_TXN_CTE, FEATURES_CTE, src="otxn", **SUBS))
def q_features_orders_ties(spark, sf):
    from ledgerscope.plans.q_core import _feature_select
    return _feature_select(compute_features(orders_txn_view(spark, sf), FIX))


_TIES_SQL = """SELECT a.transaction_id, count(*) AS rolling_count, round(CAST(sum(b.amount) AS DOUBLE), 2) AS rolling_sum,
  round(CAST(sum(b.amount) AS DOUBLE) / count(*), 4) AS rolling_avg
FROM otxn a JOIN otxn b ON b.customer_id = a.customer_id AND b.timestamp > a.timestamp - INTERVAL 7 DAY
  AND (b.timestamp < a.timestamp OR (b.timestamp = a.timestamp AND b.transaction_id <= a.transaction_id))
GROUP BY a.transaction_id"""


@register("win_rolling_ties_ordered", with_ctes(_TIES_SQL, ORDERS_TXN_CTE))
def q_win_rolling_ties_ordered(spark, sf):
    r = rolling_features(orders_txn_view(spark, sf), 7, FIX, ties="ordered")
    return r.select("transaction_id", "rolling_count", F.round("rolling_sum", 2).alias("rolling_sum"),
                    F.round("rolling_avg", 4).alias("rolling_avg"))


@register("rolling_7d_avg", with_ctes("""SELECT transaction_id, round(avg(CAST(amount AS DOUBLE)) OVER (
  PARTITION BY customer_id ORDER BY epoch_us(timestamp) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW), 4)
  AS rolling_avg FROM txn""", TXN_CTE))
def q_rolling_7d_avg(spark, sf):
    r = rolling_features(txn_view(spark, sf), 7, FIX)
    return r.select("transaction_id", F.round("rolling_avg", 4).alias("rolling_avg"))


@register("win_structuring_5d_max", with_ctes(
    "SELECT customer_id, max(window_count) AS max_window_count FROM juw GROUP BY customer_id",
    TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_win_structuring_5d_max(spark, sf):
    w = structuring_windows(txn_view(spark, sf), FIX)
    return w.groupBy("customer_id").agg(F.max("window_count").alias("max_window_count"))


@register("daily_txn_count", with_ctes(
    "SELECT transaction_id, count(*) OVER (PARTITION BY customer_id, CAST(timestamp AS DATE)) AS daily_txn_count "
    "FROM txn", TXN_CTE))
def q_daily_txn_count(spark, sf):
    return daily_txn_count(txn_view(spark, sf)).select("transaction_id", "daily_txn_count")


@register("daily_burst", with_ctes(
    "SELECT customer_id, CAST(timestamp AS DATE) AS date, count(*) AS daily_txn_count, "
    "round(CAST(sum(amount) AS DOUBLE), 2) AS daily_amount FROM txn GROUP BY 1, 2 HAVING count(*) >= 8", TXN_CTE))
def q_daily_burst(spark, sf):
    return A.daily_burst(txn_view(spark, sf), 8).withColumn("daily_amount", F.round("daily_amount", 2))


@register("daily_burst_24h", with_ctes("""SELECT customer_id, max(c) AS max_24h_count,
  CAST(min(CASE WHEN c >= 8 THEN timestamp END) AS TIMESTAMP) AS first_reached FROM (
  SELECT customer_id, timestamp, count(transaction_id) OVER (PARTITION BY customer_id ORDER BY epoch_us(timestamp)
         RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS c FROM txn) w
GROUP BY customer_id HAVING max(c) >= 8""", TXN_CTE))
def q_daily_burst_24h(spark, sf):
    from ledgerscope.operators.features import burst_24h
    b = burst_24h(txn_view(spark, sf), 8, FIX)
    return b.select("customer_id", "max_24h_count", F.col("first_reached").cast("timestamp_ntz").alias("first_reached"))


@register("win_train_split", with_ctes("""SELECT transaction_id, row_index, row_index <= floor(n * 0.7) AS is_train
FROM (SELECT transaction_id, row_number() OVER (ORDER BY customer_id, timestamp, transaction_id) AS row_index,
             count(*) OVER () AS n FROM txn)""", TXN_CTE))
def q_win_train_split(spark, sf):
    return A.win_train_split(txn_view(spark, sf)).select("transaction_id", "row_index", "is_train")


# ---------------------------------------------------------------- 2.G sorts / top-k
@register("sort_by_time", with_ctes(
    "SELECT transaction_id, CAST(timestamp AS TIMESTAMP) AS timestamp FROM txn ORDER BY timestamp, transaction_id",
    TXN_CTE))
def q_sort_by_time(spark, sf):
    return (txn_view(spark, sf).orderBy(F.col("timestamp").asc_nulls_last(), "transaction_id")
            .select("transaction_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp")))


@register("sort_customer_time", with_ctes(
    "SELECT customer_id, transaction_id FROM txn ORDER BY customer_id, timestamp, transaction_id", TXN_CTE))
def q_sort_customer_time(spark, sf):
    # Range partitioning on all three columns: a hot customer spans as many tasks as its rows need.
    return txn_view(spark, sf).orderBy("customer_id", "timestamp", "transaction_id").select("customer_id", "transaction_id")


@register("topk_customers_volume", with_ctes(
    "SELECT customer_id, round(CAST(sum(amount) AS DOUBLE), 2) AS total_amount FROM txn GROUP BY 1 "
    "ORDER BY total_amount DESC, customer_id LIMIT 5", TXN_CTE))
def q_topk_volume(spark, sf):
    a = A.agg_customer(txn_view(spark, sf)).select("customer_id", F.round("total_amount", 2).alias("total_amount"))
    return A.top_customers(a, 5, by="total_amount")


@register("topk_customers_count", with_ctes(
    "SELECT customer_id, count(transaction_id) AS transaction_count FROM txn WHERE amount < 10000 GROUP BY 1 "
    "ORDER BY transaction_count DESC, customer_id LIMIT 10", TXN_CTE))
def q_topk_count(spark, sf):
    a = A.agg_customer(filter_txn(txn_view(spark, sf), Filters(amount_threshold=10000.0)))
    return A.top_customers(a, 10).select("customer_id", "transaction_count")


# ---------------------------------------------------------------- 2.H sets
@register("union_rule_hits", with_ctes(
    "SELECT customer_id, rule_fired, rule_score FROM hits UNION ALL "
    "SELECT customer_id, rule_fired, rule_score FROM lay", TXN_CTE, STRUCTURING_CTE,
    GRAPH_CTE,
    """lay AS (SELECT a AS customer_id, 'layering' AS rule_fired, 85.0 AS rule_score FROM (
      SELECT DISTINCT e1.src AS a FROM edges e1 JOIN edges e2 ON e1.dst = e2.src WHERE e2.dst <> e1.src))""",
    **SUBS))
def q_union_rule_hits(spark, sf):
    txn = txn_view(spark, sf)
    s = detect_structuring(txn, FIX).select("customer_id", "rule_fired", "rule_score")
    lay = detect_layering(build_transfer_graph(txn)).select("customer_id", "rule_fired", "rule_score")
    return union_rule_hits(s, lay)


@register("union_flagged_customers", with_ctes(
    "SELECT customer_id FROM hits UNION SELECT customer_id FROM ml", *CONS_SQL_CTES[:-1], **CONS_SUBS))
def q_union_flagged(spark, sf):
    txn = txn_view(spark, sf)
    ml = score_threshold_flag(customer_scores_minmax(compute_features(txn, FIX)), FIX)
    return union_flagged_customers(detect_structuring(txn, FIX), ml)


@register("distinct_demographics", with_ctes(
    "SELECT DISTINCT customer_id, country, customer_segment FROM txn", TXN_CTE))
def q_distinct_demographics(spark, sf):
    return distinct_demographics(txn_view(spark, sf))


# ---------------------------------------------------------------- 2.I scalar functions
@register("fn_currency_fmt", with_ctes("""SELECT customer_id, CASE WHEN v >= 1e9 THEN printf('$%.2fB', v / 1e9)
  WHEN v >= 1e6 THEN printf('$%.2fM', v / 1e6) WHEN v >= 1e3 THEN printf('$%.2fK', v / 1e3)
  ELSE printf('$%.2f', v) END AS volume FROM (SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS v FROM txn
  GROUP BY 1)""", TXN_CTE))
def q_fn_currency_fmt(spark, sf):
    a = A.agg_customer(txn_view(spark, sf))
    return a.select("customer_id", currency_short(F.col("total_amount")).alias("volume"))


@register("fn_money_fmt", with_ctes(
    "SELECT transaction_id, format('{:,.2f}', CAST(amount AS DOUBLE)) AS amount_text FROM txn", TXN_CTE))
def q_fn_money_fmt(spark, sf):
    return txn_view(spark, sf).select("transaction_id", money(F.col("amount")).alias("amount_text"))


@register("fn_extract_amounts", "SELECT customer_id, len(a) AS n_amounts, round(coalesce(list_sum(a), 0.0), 2) AS "
    "sum_amounts FROM (SELECT customer_id, list_transform(regexp_extract_all(explanation, "
    "'\\$([\\d,]+(?:\\.\\d+)?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS a FROM ("
    + _flagship_sql() + ") f) x")
def q_fn_extract_amounts(spark, sf):
    f = flagship_structuring(txn_view(spark, sf), FIX, minmax_model)
    a = dollar_amounts(F.col("explanation"))
    return f.select("customer_id", F.size(a).cast("long").alias("n_amounts"),
                    F.round(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), 2).alias("sum_amounts"))


@register("fn_pad_id", "SELECT event_id, 'TXN' || printf('%09d', event_id) AS transaction_id, "
                       "printf('IBM%07d', event_id) AS bank_txn_id FROM events")
def q_fn_pad_id(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.concat(F.lit("TXN"), zero_padded(F.col("event_id"), 9))
                    .alias("transaction_id"), F.format_string("IBM%07d", "event_id").alias("bank_txn_id"))


@register("fn_feature_tags", with_ctes(f"SELECT customer_id, {tags_sql(FIX)} AS top_features FROM cf",
                                       TXN_CTE, FEATURES_CTE, CUSTOMER_FEATURES_CTE, **SUBS))
def q_fn_feature_tags(spark, sf):
    from ledgerscope.operators.scoring import feature_tags
    cf = A.agg_customer_features(compute_features(txn_view(spark, sf), FIX))
    return cf.select("customer_id", F.array_join(feature_tags(cf, FIX), ",").alias("top_features"))


@register("fn_minmax", with_ctes("SELECT customer_id, round(score, 6) AS score FROM sc",
                                 TXN_CTE, FEATURES_CTE, CUSTOMER_FEATURES_CTE, MINMAX_ML_CTE, **SUBS, **ML_SUBS))
def q_fn_minmax(spark, sf):
    s = customer_scores_minmax(compute_features(txn_view(spark, sf), FIX))
    return s.select("customer_id", F.round("score", 6).alias("score"))


@register("fn_json_payload", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_fn_json_payload(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---------------------------------------------------------------- 2.J decisions and pipelines
@register("structuring_per_customer", with_ctes(
    "SELECT * FROM hits WHERE customer_id IN (SELECT customer_id FROM req)", TXN_CTE, STRUCTURING_CTE,
    f"req AS ({_REQ_SQL})", **SUBS))
def q_structuring_per_customer(spark, sf):
    return structuring_for_customers(txn_view(spark, sf), _requested(spark, sf), FIX)


@register("score_aggregation", with_ctes(
    "SELECT customer_id, transaction_count, least(95.0, 40.0 + 4.0 * transaction_count) AS risk_score_raw FROM a",
    TXN_CTE, "a AS (SELECT customer_id, count(transaction_id) AS transaction_count FROM txn WHERE amount < 10000 "
             "GROUP BY 1)"))
def q_score_aggregation(spark, sf):
    a = A.agg_customer(filter_txn(txn_view(spark, sf), Filters(amount_threshold=10000.0)))
    return score_aggregation(a).select("customer_id", "transaction_count", "risk_score_raw")


_LOOKUP_SQL = """
, req AS (""" + _REQ_SQL + """),
prof AS (SELECT customer_id, count(transaction_id) AS transactions_count,
                round(CAST(sum(amount) AS DOUBLE), 2) AS total_volume, round(avg(CAST(amount AS DOUBLE)), 2) AS avg_amount,
                max(CAST(amount AS DOUBLE)) AS max_amount FROM txn WHERE customer_id IN (SELECT customer_id FROM req)
         GROUP BY 1),
lk AS (SELECT r.customer_id, p.transactions_count IS NOT NULL AS found,
              coalesce(p.transactions_count, 0) AS transactions_count, p.total_volume, p.avg_amount,
              CASE WHEN p.transactions_count IS NULL THEN 0.0 ELSE greatest(coalesce(h.rule_score, 10.0), 10.0,
                   CASE WHEN coalesce(p.max_amount > 50000.0, false) THEN 75.0 ELSE 0.0 END) END AS entity_score,
              concat_ws(',', CASE WHEN h.rule_score IS NOT NULL THEN 'structuring' END,
                        CASE WHEN coalesce(p.max_amount > 50000.0, false) THEN 'high_single_transaction_amount' END)
                AS flagged_patterns
       FROM req r LEFT JOIN prof p ON r.customer_id = p.customer_id LEFT JOIN hits h ON r.customer_id = h.customer_id)"""


def _lookup_sql(select):
    s = with_ctes("SELECT 1", TXN_CTE, STRUCTURING_CTE, **SUBS)
    return s[: -len("SELECT 1")].rstrip() + _LOOKUP_SQL + "\n" + select


@register("lookup_entity", _lookup_sql("SELECT * FROM lk"))
def q_lookup_entity(spark, sf):
    return lookup_entity(txn_view(spark, sf), _requested(spark, sf), FIX)


def _entity_sql_select():
    from ledgerscope.plans.sqlparts import action_sql, explanation_sql, risk_level_sql, risk_score_sql
    pat = ("CASE WHEN NOT found THEN 'entity_not_found' WHEN flagged_patterns = '' THEN 'entity_check' "
           "ELSE split_part(flagged_patterns, ',', 1) END")
    lvl = risk_level_sql("entity_score", "pattern_matched")
    return f"""SELECT customer_id, found, pattern_matched,
  CASE WHEN NOT found THEN 0.0 ELSE {risk_score_sql('entity_score', 'pattern_matched')} END AS risk_score,
  CASE WHEN NOT found THEN 'Low' ELSE {lvl} END AS risk_level,
  CASE WHEN NOT found THEN 'monitor' ELSE {action_sql(lvl)} END AS recommended_action,
  CASE WHEN NOT found THEN 100.0 ELSE 90.0 END AS confidence, CASE WHEN NOT found THEN 100.0 ELSE 85.0 END AS trust_score,
  transactions_count AS evidence_count,
  CASE WHEN NOT found THEN printf('{NOT_FOUND_TEXT}', customer_id)
       ELSE {explanation_sql('customer_id', 'pattern_matched', lvl, 'transactions_count', 'total_volume')} END
    AS explanation
FROM (SELECT *, {pat} AS pattern_matched FROM lk) e"""


@register("pipeline_entity", _lookup_sql(_entity_sql_select()))
def q_pipeline_entity(spark, sf):
    return pipeline_entity(txn_view(spark, sf), _requested(spark, sf), FIX)


_VERIFY_SELECT = """
, f AS (SELECT * FROM (""" + "{flagship}" + """) x),
ev_amt AS (SELECT DISTINCT ev.customer_id, t.amount AS amt FROM ev JOIN txn t ON ev.transaction_id = t.transaction_id),
ev_sum AS (SELECT ev.customer_id, sum(t.amount) AS s FROM ev JOIN txn t ON ev.transaction_id = t.transaction_id GROUP BY 1),
quoted AS (SELECT customer_id, CAST(replace(unnest(regexp_extract_all(explanation, '\\$([\\d,]+(?:\\.\\d+)?)', 1)),
                  ',', '') AS DECIMAL(18,2)) AS q FROM f),
bad AS (SELECT DISTINCT q.customer_id FROM quoted q JOIN ev_sum s ON q.customer_id = s.customer_id
        WHERE NOT EXISTS (SELECT 1 FROM ev_amt a WHERE a.customer_id = q.customer_id AND a.amt = q.q)
          AND q.q <> s.s AND q.q <> 10000.0),
chk AS (SELECT f.*, CASE WHEN coalesce(lower(pattern_matched) IN ('structuring','smurfing','layering'), false)
                          AND risk_score <= 30.0 THEN 'Medium' ELSE {level} END AS exp_level,
               f.customer_id IN (SELECT customer_id FROM bad) AS has_bad FROM f),
fx AS (SELECT *, CASE WHEN exp_level IN ('High','Critical') AND recommended_action = 'monitor' THEN 'report'
                      WHEN exp_level = 'Low' AND recommended_action = 'report' THEN 'monitor'
                      ELSE recommended_action END AS fixed_action FROM chk)
SELECT customer_id, exp_level AS risk_level, fixed_action AS recommended_action, risk_level = exp_level AS level_ok,
       fixed_action = recommended_action AS action_ok, NOT has_bad AS amounts_ok,
       risk_level = exp_level AND fixed_action = recommended_action AND NOT has_bad AS item_passed FROM fx"""


def _verify_sql():
    from ledgerscope.plans.sqlparts import level_sql
    flag = _flagship_sql()
    head = flag[: flag.index("\nSELECT customer_id, agreement, verdict")]
    body = flag[flag.index("\nSELECT customer_id, agreement, verdict"):]
    return head + _VERIFY_SELECT.replace("{flagship}", body).replace("{level}", level_sql("risk_score"))


def _verify(spark, sf):
    from ledgerscope.operators.decide import verify_results
    items, evidence = flagship_items(txn_view(spark, sf), FIX, minmax_model)
    return verify_results(items, evidence, FIX)


@register("verify_results", _verify_sql())
def q_verify_results(spark, sf):
    """Fact-check of the flagship output against the evidence of each item (join over quoted amounts)."""
    return _verify(spark, sf).select("customer_id", "risk_level", "recommended_action", "level_ok", "action_ok",
                                     "amounts_ok", "item_passed")


@register("verification_status", "SELECT count(*) AS items_audited, coalesce(bool_and(item_passed), true) AS "
          "all_passed, CASE WHEN coalesce(bool_and(item_passed), true) THEN 'Passed' ELSE 'Needs Review' END AS "
          "status FROM (" + _verify_sql() + ") v")
def q_verification_status(spark, sf):
    return verification_status(_verify(spark, sf))


@register("results_table", "SELECT customer_id, printf('%.1f', risk_score) AS risk_score, risk_level, "
                           "upper(recommended_action) AS action, coalesce(pattern_matched, 'N/A') AS pattern, "
                           "printf('%.1f', confidence) AS confidence, evidence_count AS evidence FROM ("
                           + _flagship_sql() + ") f")
def q_results_table(spark, sf):
    return results_table(flagship_structuring(txn_view(spark, sf), FIX, minmax_model))


def _assemble_sql(precedence: bool = True):
    from ledgerscope.plans.registry import ORACLES
    cols = "customer_id, pattern_matched, risk_score, risk_level, recommended_action, confidence, trust_score, " \
           "evidence_count, explanation"
    parts = [("entity_lookup", ORACLES["pipeline_entity"]), ("aggregation_rule", ORACLES["pipeline_aggregation"]),
             ("consensus", _flagship_sql())]
    union = " UNION ALL ".join(f"SELECT {i} AS p, '{m}' AS mode, {cols} FROM ({sql}) x{i}" for i, (m, sql) in enumerate(parts))
    return (f"SELECT mode, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY p) AS rn FROM ({union}) u) r "
            "WHERE rn = 1")


@register("assemble_flagged", _assemble_sql())
def q_assemble_flagged(spark, sf):
    """Entity, aggregation and consensus items of one run; a customer keeps the item of the first mode."""
    txn = txn_view(spark, sf)
    return assemble_flagged(pipeline_entity(txn, _requested(spark, sf), FIX),
                            pipeline_aggregation(txn, AGG_FILTERS, FIX), flagship_structuring(txn, FIX, minmax_model))


_EVIDENCE_ENTITY = f"SELECT customer_id, transaction_id, CAST(amount AS DOUBLE) AS amount FROM txn WHERE customer_id IN ({_REQ_SQL})"
_EVIDENCE_AGG = """SELECT customer_id, transaction_id, CAST(amount AS DOUBLE) AS amount FROM txn WHERE amount < 10000.0 AND customer_id IN (
  SELECT customer_id FROM txn WHERE amount < 10000.0 GROUP BY customer_id HAVING count(transaction_id) >= 10)"""


def _evidence(df):
    return df.withColumn("amount", F.col("amount").cast("double"))


@register("evidence_entity", with_ctes(_EVIDENCE_ENTITY, TXN_CTE))
def q_evidence_entity(spark, sf):
    """Evidence rows of the requested customers."""
    return _evidence(evidence_entity(txn_view(spark, sf), _requested(spark, sf)))


@register("evidence_aggregation", with_ctes(_EVIDENCE_AGG, TXN_CTE))
def q_evidence_aggregation(spark, sf):
    """Evidence rows of the aggregation items: their filtered rows."""
    return _evidence(evidence_aggregation(txn_view(spark, sf), AGG_FILTERS, FIX))


@register("evidence_consensus", with_ctes(
    "SELECT e.customer_id, e.transaction_id, CAST(t.amount AS DOUBLE) AS amount FROM ("
    "SELECT customer_id, transaction_id FROM ju WHERE customer_id IN (SELECT customer_id FROM hits) "
    "UNION SELECT customer_id, transaction_id FROM txn WHERE customer_id IN (SELECT customer_id FROM ml)) e "
    "JOIN txn t USING (transaction_id)", *CONS_SQL_CTES, **CONS_SUBS))
def q_evidence_consensus(spark, sf):
    """Evidence rows of the flagship items."""
    return _evidence(flagship_items(txn_view(spark, sf), FIX, minmax_model)[1])


def _verify_modes_sql():
    from ledgerscope.plans.sqlparts import level_sql
    evidence = " UNION ALL ".join(
        f"SELECT '{m}' AS mode, customer_id, CAST(amount AS DECIMAL(18,2)) AS amt FROM ({sql}) e{i}"
        for i, (m, sql) in enumerate([("entity_lookup", with_ctes(_EVIDENCE_ENTITY, TXN_CTE)),
                                      ("aggregation_rule", with_ctes(_EVIDENCE_AGG, TXN_CTE)),
                                      ("consensus", _ORACLES()["evidence_consensus"])]))
    return f"""WITH f AS ({_assemble_sql()}), ev AS ({evidence}),
s AS (SELECT mode, customer_id, sum(amt) AS s FROM ev GROUP BY 1, 2),
q AS (SELECT mode, customer_id, CAST(replace(unnest(regexp_extract_all(explanation, '\\$([\\d,]+(?:\\.\\d+)?)', 1)), ',', '') AS DECIMAL(18,2)) AS q FROM f),
bad AS (SELECT DISTINCT q.mode, q.customer_id FROM q JOIN s USING (mode, customer_id)
        WHERE q.q <> s.s AND q.q <> 10000.0 AND NOT EXISTS (
          SELECT 1 FROM ev WHERE ev.mode = q.mode AND ev.customer_id = q.customer_id AND ev.amt = q.q))
SELECT f.mode, f.customer_id, f.risk_level = CASE WHEN coalesce(f.pattern_matched IN ('structuring','smurfing','layering'), false)
         AND f.risk_score <= 30.0 THEN 'Medium' ELSE {level_sql('f.risk_score')} END AS level_ok,
       b.customer_id IS NULL AS amounts_ok
FROM f LEFT JOIN bad b ON b.mode = f.mode AND b.customer_id = f.customer_id"""


def _ORACLES():
    from ledgerscope.plans.registry import ORACLES
    return ORACLES


def _response(spark, sf):
    return run_response(txn_view(spark, sf), FIX, minmax_model, _requested(spark, sf), AGG_FILTERS)


@register("verify_all_modes", _verify_modes_sql())
def q_verify_all_modes(spark, sf):
    """The items of all three modes of one run, each checked against its evidence."""
    return _response(spark, sf).verification.select("mode", "customer_id", "level_ok", "amounts_ok")


@register("run_response_totals", f"""WITH f AS ({_assemble_sql()}),
e AS ({" UNION ALL ".join(f"SELECT '{m}' AS mode, customer_id, transaction_id FROM ({sql}) e{i}" for i, (m, sql) in enumerate([
    ("entity_lookup", with_ctes(_EVIDENCE_ENTITY, TXN_CTE)), ("aggregation_rule", with_ctes(_EVIDENCE_AGG, TXN_CTE)),
    ("consensus", _ORACLES()["evidence_consensus"])]))})
SELECT (SELECT count(DISTINCT customer_id) FROM f) AS flagged_entities,
  (SELECT count(DISTINCT transaction_id) FROM e WHERE (mode, customer_id) IN (SELECT mode, customer_id FROM f)) AS evidence_ids,
  (SELECT count(*) FROM events) AS scanned_rows, (SELECT count(DISTINCT user_id) FROM events) AS evaluated_customers""")
def q_run_response_totals(spark, sf):
    """Totals of a whole run over the three modes."""
    return _response(spark, sf).totals


@register("split_valid", with_ctes("""SELECT customer_id, round(avg(a), 4) AS amount_mean, count(*) AS clean_rows FROM (
  SELECT customer_id, CASE WHEN transaction_type = 'fee' THEN -CAST(amount AS DOUBLE)
                           WHEN channel = 'atm' AND amount < 100 THEN NULL ELSE CAST(amount AS DOUBLE) END AS a FROM txn) x
WHERE a >= 0 GROUP BY 1""", TXN_CTE))
def q_split_valid(spark, sf):
    """Customer statistics over the clean side of an input with missing and negative amounts."""
    from ledgerscope.operators.quality import split_valid
    from ledgerscope.plans.q_io import _txn_text
    from ledgerscope.sources.files import typed_txn
    clean, _ = split_valid(_txn_text(spark, sf))
    txn = typed_txn(clean)
    n = txn.groupBy("customer_id").agg(F.count(F.lit(1)).alias("clean_rows"))
    return (customer_amount_stats(txn).join(n, "customer_id")
            .select("customer_id", F.round("amount_mean", 4).alias("amount_mean"), "clean_rows"))


_NULLS_CTE = """ntxn AS (
  SELECT * REPLACE (CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % 7 = 0 THEN NULL ELSE amount END AS amount,
                    CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % 11 = 0 THEN NULL ELSE country END AS country) FROM txn)"""


@register("features_null_amounts", with_ctes("""SELECT transaction_id,
  round(coalesce((CAST(t.amount AS DOUBLE) - s.amount_mean) / (s.amount_std + 1e-6), -999.0), 4) AS zscore,
  count(*) OVER w7 AS rolling_7d_count, round(CAST(coalesce(sum(t.amount) OVER w30, 0) AS DOUBLE), 2) AS rolling_30d_sum
FROM ntxn t JOIN stats s USING (customer_id)
WINDOW w7 AS (PARTITION BY t.customer_id ORDER BY epoch_us(t.timestamp) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY t.customer_id ORDER BY epoch_us(t.timestamp) RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW)""",
    TXN_CTE, _NULLS_CTE, FEATURES_CTE.split(",\nfeat AS")[0], src="ntxn", **SUBS))
def q_features_null_amounts(spark, sf):
    """Features of an input in which a seventh of the amounts is missing, by prefix differences."""
    t = txn_view(spark, sf)
    n = F.expr("CAST(substring(transaction_id, 4) AS BIGINT)")
    t = t.withColumn("amount", F.when(n % 7 != 0, F.col("amount"))).withColumn("country", F.when(n % 11 != 0, F.col("country")))
    f = compute_features(t, FIX.replace(rolling_strategy="prefix"))
    return f.select("transaction_id", F.round(F.coalesce("amount_zscore_vs_customer_avg", F.lit(-999.0)), 4).alias("zscore"),
                    "rolling_7d_count", F.round("rolling_30d_sum", 2).alias("rolling_30d_sum"))
