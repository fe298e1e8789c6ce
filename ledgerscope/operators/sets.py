"""Set operations, joins of results, ordering helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_rule_hits(*hits: DataFrame) -> DataFrame:
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h, allowMissingColumns=True)
    return out


def union_flagged_customers(rule_hits: DataFrame, ml_hits: DataFrame) -> DataFrame:
    return rule_hits.select("customer_id").union(ml_hits.select("customer_id")).distinct()


def distinct_demographics(txn: DataFrame) -> DataFrame:
    return txn.select("customer_id", "country", "customer_segment").distinct()


def semi_flagged(txn: DataFrame, flagged: DataFrame) -> DataFrame:
    """0/1 flag per row: its customer is among the flagged (left join of the distinct ids)."""
    ids = flagged.select("customer_id").distinct().withColumn("_hit", F.lit(1))
    return txn.join(ids, "customer_id", "left").withColumn("flagged", F.coalesce("_hit", F.lit(0))).drop("_hit")


def unflagged_customers(txn: DataFrame, flagged: DataFrame) -> DataFrame:
    """Customers with no flag (left anti join)."""
    return txn.select("customer_id").distinct().join(flagged.select("customer_id"), "customer_id", "left_anti")


def join_rule_ml_outer(rule_hits: DataFrame, ml_hits: DataFrame) -> DataFrame:
    r = rule_hits.select("customer_id", "rule_score", F.lit(True).alias("has_rule"))
    m = ml_hits.select("customer_id", "ml_score", F.lit(True).alias("has_ml"))
    return (r.join(m, "customer_id", "full_outer")
            .select("customer_id", F.coalesce("has_rule", F.lit(False)).alias("has_rule"),
                    F.coalesce("has_ml", F.lit(False)).alias("has_ml"), "rule_score", "ml_score"))
