"""Reusable DuckDB SQL fragments for the oracle statements (mirrors of the Spark expressions)."""

from ledgerscope.params import DEFAULT_PARAMS


def level_sql(score: str, p=DEFAULT_PARAMS) -> str:
    return (f"CASE WHEN {score} <= {p.risk_low_max} THEN 'Low' WHEN {score} <= {p.risk_medium_max} THEN 'Medium' "
            f"WHEN {score} <= {p.risk_high_max} THEN 'High' ELSE 'Critical' END")


def forced_sql(pattern: str, score: str, p=DEFAULT_PARAMS) -> str:
    return f"(coalesce({pattern} IN ('structuring','smurfing','layering'), false) AND {score} <= {p.risk_low_max})"


def risk_score_sql(score: str, pattern: str, p=DEFAULT_PARAMS) -> str:
    return f"round(CASE WHEN {forced_sql(pattern, score, p)} THEN greatest({score}, 45.0) ELSE {score} END, 1)"


def risk_level_sql(score: str, pattern: str, p=DEFAULT_PARAMS) -> str:
    return f"CASE WHEN {forced_sql(pattern, score, p)} THEN 'Medium' ELSE {level_sql(score, p)} END"


def action_sql(level: str) -> str:
    return (f"CASE WHEN lower({level}) = 'low' THEN 'monitor' WHEN lower({level}) = 'medium' THEN 'review' "
            f"WHEN lower({level}) IN ('high','critical') THEN 'report' ELSE 'review' END")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def explanation_sql(cust: str, pattern: str, level: str, n: str, total: str) -> str:
    from ledgerscope.functions.exprs import EXPLAIN_LAYERING, EXPLAIN_OTHER, EXPLAIN_OUTLIER, EXPLAIN_STRUCTURING
    n = f"CAST(coalesce({n}, 0) AS BIGINT)"
    total = f"coalesce(CAST({total} AS DOUBLE), 0.0)"
    return f"""CASE
  WHEN {pattern} IN ('structuring','smurfing') THEN printf({_q(EXPLAIN_STRUCTURING)}, {cust}, {n}, format('{{:,.2f}}', {total}))
  WHEN {pattern} = 'layering' THEN printf({_q(EXPLAIN_LAYERING)}, {cust}, {n})
  WHEN {pattern} IN ('statistical_anomaly','high_amount_zscore') THEN printf({_q(EXPLAIN_OUTLIER)}, {cust}, {n})
  ELSE printf({_q(EXPLAIN_OTHER)}, {cust}, coalesce({pattern}, 'suspicious activity'), {level}, {n})
END"""


def tags_sql(p=DEFAULT_PARAMS) -> str:
    s = ("concat_ws(',', CASE WHEN max_zscore > 3.0 THEN 'high_amount_zscore' END, "
         "CASE WHEN max_rolling_7d_count > 10 THEN 'high_transaction_velocity' END, "
         f"CASE WHEN amount_max > {p.large_amount} THEN 'extreme_transaction_amount' END)")
    return f"CASE WHEN {s} = '' THEN 'multivariate_statistical_outlier' ELSE {s} END"


CUSTOMER_FEATURES_CTE = """cf AS (
  SELECT customer_id, avg(CAST(amount AS DOUBLE)) AS amount_mean, max(CAST(amount AS DOUBLE)) AS amount_max,
         CAST(sum(amount) AS DOUBLE) AS amount_sum, CAST(max(rolling_7d_count) AS DOUBLE) AS max_rolling_7d_count,
         max(rolling_30d_sum) AS max_rolling_30d_sum, max(amount_zscore_vs_customer_avg) AS max_zscore,
         min(velocity_hours_since_last_txn) AS min_velocity_hours, count(transaction_id) AS n_txn
  FROM feat GROUP BY customer_id)"""

MINMAX_ML_CTE = """sc AS (
  SELECT cf.*, CASE WHEN m.mx > m.mn THEN (amount_max - m.mn) / (m.mx - m.mn) ELSE 0.0 END AS score
  FROM cf, (SELECT min(amount_max) AS mn, max(amount_max) AS mx FROM cf) m),
ml AS (
  SELECT customer_id, round(score, 3) AS ml_score, {tags} AS top_features
  FROM sc WHERE score >= {thr})"""

CONSENSUS_CTE = """cons AS (
  SELECT coalesce(h.customer_id, m.customer_id) AS customer_id,
         h.customer_id IS NOT NULL AS has_rule, m.customer_id IS NOT NULL AS has_ml,
         CAST(coalesce(h.rule_score, 0.0) AS DECIMAL(12,4)) AS rs,
         CAST(coalesce(m.ml_score, 0.0) AS DECIMAL(12,4)) * CAST(100 AS DECIMAL(12,4)) AS ms,
         h.rule_fired, h.txn_count AS rule_txn_count, h.total_amount AS rule_total_amount, m.top_features
  FROM {rules} h FULL OUTER JOIN ml m ON h.customer_id = m.customer_id),
cons2 AS (
  SELECT customer_id, has_rule, has_ml, rule_txn_count, rule_total_amount, top_features,
         CASE WHEN has_rule AND has_ml THEN 'Full agreement' WHEN has_rule THEN 'Partial'
              WHEN has_ml THEN 'Disagreement' ELSE 'None' END AS agreement,
         CAST(round(CASE WHEN has_rule THEN rs ELSE 0.0 END, 1) AS DOUBLE) AS rule_score,
         CAST(round(CASE WHEN has_ml THEN ms ELSE 0.0 END, 1) AS DOUBLE) AS ml_score,
         CAST(round(CASE WHEN has_rule AND has_ml THEN CAST(0.7 AS DECIMAL(12,4)) * rs
                         + CAST(0.3 AS DECIMAL(12,4)) * ms WHEN has_rule THEN greatest(rs, 75.0)
                    WHEN has_ml THEN ms ELSE 10.0 END, 1) AS DOUBLE) AS combined_score,
         CASE WHEN has_rule AND has_ml THEN 95.0 WHEN has_rule THEN 80.0 WHEN has_ml THEN 55.0 ELSE 90.0 END
           AS trust_score,
         CASE WHEN has_rule AND has_ml THEN 'Confirmed Suspicious' WHEN has_rule THEN 'Rule Violation'
              WHEN has_ml THEN 'Statistical Outlier' ELSE 'Normal' END AS verdict,
         CASE WHEN has_rule THEN coalesce(rule_fired, 'pattern_match') WHEN has_ml THEN 'statistical_anomaly' END
           AS pattern_matched
  FROM cons)"""
