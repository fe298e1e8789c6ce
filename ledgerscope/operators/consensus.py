"""Consensus of rule hits and model hits per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# When one customer has hits of several rules, the highest priority rule is kept
# (the reference keeps the last one run; layering runs after structuring).
DEFAULT_RULE_PRIORITY = {"structuring": 1, "layering": 2}


def _priority(rule: F.Column, priority: dict[str, int]) -> F.Column:
    expr = F.lit(0)
    for name, rank in priority.items():
        expr = F.when(rule == name, F.lit(rank)).otherwise(expr)
    return expr


def dedupe_rule_hits(rule_hits: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """One rule hit per customer, chosen by rule priority (ties: higher score)."""
    pr = priority or DEFAULT_RULE_PRIORITY
    cols = ["rule_fired", "rule_score", "txn_count", "total_amount"]
    picked = (rule_hits.select("customer_id", *cols)
              .groupBy("customer_id")
              .agg(F.max_by(F.struct(*cols), F.struct(_priority(F.col("rule_fired"), pr), F.col("rule_score")))
                    .alias("_r")))
    return picked.select("customer_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def compute_consensus(rule_hits: DataFrame, ml_hits: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """Full outer join of rule and model hits with the four agreement cases.

    both -> 0.7 rule + 0.3 model, trust 95, Confirmed Suspicious;
    rule only -> max(rule, 75), trust 80, Rule Violation;
    model only -> model, trust 55, Statistical Outlier; neither -> 10, trust 90, Normal.
    Model scores are 0..1 and enter as percentages. Scores are rounded to 1 dp.
    """
    rules = dedupe_rule_hits(rule_hits, priority).withColumn("_has_rule", F.lit(True))
    ml = ml_hits.select("customer_id", F.col("ml_score").alias("_ml_raw"),
                        F.coalesce(F.col("anomaly_flag"), F.lit(False)).alias("_has_ml"))
    j = rules.join(ml, "customer_id", "full_outer")
    has_rule = F.coalesce(F.col("_has_rule"), F.lit(False))
    has_ml = F.coalesce(F.col("_has_ml"), F.lit(False))
    # Scores in decimals: 0.7 * 85 + 0.3 * 61.5 is 77.95 exactly and rounds to 78.0, not to 77.9 as a
    # binary double would; every engine then rounds the same value.
    dec = "decimal(12,4)"
    rule_score = F.when(has_rule, F.coalesce(F.col("rule_score"), F.lit(0.0))).otherwise(F.lit(0.0)).cast(dec)
    ml_score = (F.when(has_ml, F.coalesce(F.col("_ml_raw"), F.lit(0.0))).otherwise(F.lit(0.0)).cast(dec)
                * F.lit(100).cast(dec))
    both, r_only, m_only = has_rule & has_ml, has_rule & ~has_ml, ~has_rule & has_ml
    return j.select(
        "customer_id",
        F.when(both, "Full agreement").when(r_only, "Partial").when(m_only, "Disagreement")
         .otherwise("None").alias("agreement"),
        F.round(rule_score, 1).cast("double").alias("rule_score"),
        F.round(ml_score, 1).cast("double").alias("ml_score"),
        F.round(F.when(both, F.lit(0.7).cast(dec) * rule_score + F.lit(0.3).cast(dec) * ml_score)
                 .when(r_only, F.greatest(rule_score, F.lit(75.0).cast(dec)))
                 .when(m_only, ml_score).otherwise(F.lit(10.0).cast(dec)), 1).cast("double").alias("combined_score"),
        F.when(both, 95.0).when(r_only, 80.0).when(m_only, 55.0).otherwise(90.0).alias("trust_score"),
        F.when(both, "Confirmed Suspicious").when(r_only, "Rule Violation").when(m_only, "Statistical Outlier")
         .otherwise("Normal").alias("verdict"),
        F.when(has_rule, F.coalesce(F.col("rule_fired"), F.lit("pattern_match")))
         .when(has_ml, F.lit("statistical_anomaly")).alias("pattern_matched"),
        F.when(has_rule, F.col("txn_count")).alias("rule_txn_count"),
        F.when(has_rule, F.col("total_amount")).alias("rule_total_amount"),
        has_rule.alias("has_rule"), has_ml.alias("has_ml"),
    )


def consensus_evidence(rule_evidence: DataFrame, ml_evidence: DataFrame) -> DataFrame:
    """De-duplicated union of rule and model evidence rows (customer_id, transaction_id)."""
    return (rule_evidence.select("customer_id", "transaction_id")
            .unionByName(ml_evidence.select("customer_id", "transaction_id"))
            .distinct())


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Evidence rows per customer (aggregate of the long evidence table)."""
    return evidence.groupBy("customer_id").agg(F.count("transaction_id").alias("evidence_count"))
