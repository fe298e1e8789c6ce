"""Threshold structuring: many just-under-threshold transactions in a short window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.exprs import just_under
from ledgerscope.operators.windows import US_PER_DAY, rolling_sums
from ledgerscope.params import DEFAULT_PARAMS, Params


def just_under_rows(txn: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    return txn.filter(just_under(F.col("amount"), params))


def structuring_windows(txn: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Just-under rows with the count of just-under rows in ``(t - window, t]``.

    The filter runs before any shuffle; the windows use the strategy of ``Params.rolling_strategy``.
    """
    rows = just_under_rows(txn.select("customer_id", "transaction_id", "timestamp", "amount"), params)
    counted = rolling_sums(rows, ["customer_id"], "timestamp", "transaction_id",
                           [("window_count", params.structuring_window_days * US_PER_DAY, F.lit(1))], params)
    return counted.withColumn("window_count", F.col("window_count").cast("long"))


def detect_structuring(txn: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Rule hits: customers whose largest rolling count of just-under rows reaches the minimum.

    ``txn_count`` and ``total_amount`` cover all just-under rows of the customer
    (not only the densest window); score = min(100, 70 + 3 * max count), 1 dp.
    """
    p = params
    per_cust = (structuring_windows(txn, p).groupBy("customer_id")
                .agg(F.max("window_count").alias("max_window_count"),
                     F.count(F.lit(1)).alias("txn_count"),
                     F.sum("amount").alias("_total")))
    return (per_cust.filter(F.col("max_window_count") >= p.structuring_min_count)
            .select("customer_id",
                    F.lit("structuring").alias("rule_fired"),
                    "txn_count",
                    F.round(F.col("_total"), 2).cast("double").alias("total_amount"),
                    F.round(F.least(F.lit(100.0), F.lit(70.0) + F.col("max_window_count") * 3.0), 1)
                     .alias("rule_score"),
                    "max_window_count"))


def structuring_evidence(txn: DataFrame, hits: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Evidence rows (customer_id, transaction_id) of the hits: every just-under row of a hit customer.

    Long form instead of a per-customer array, so a customer with millions of
    rows never becomes one in-memory value.
    """
    return (just_under_rows(txn.select("customer_id", "transaction_id", "amount"), params)
            .join(hits.select("customer_id"), "customer_id", "left_semi")
            .select("customer_id", "transaction_id"))


def structuring_for_customers(txn: DataFrame, customers: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Structuring restricted to the requested customers (semi-join first, then the rule)."""
    return detect_structuring(txn.join(customers.select("customer_id"), "customer_id", "left_semi"), params)


def structuring_from_customers(customers: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Rule hits from the per-customer table of ``agg_customer_features`` (features with the structuring count).

    Same hits as ``detect_structuring`` without another pass over the rows.
    """
    p = params
    return (customers.filter(F.col("max_structuring_count") >= p.structuring_min_count)
            .select("customer_id", F.lit("structuring").alias("rule_fired"),
                    F.col("n_just_under").alias("txn_count"),
                    F.round(F.col("just_under_total"), 2).cast("double").alias("total_amount"),
                    F.round(F.least(F.lit(100.0), F.lit(70.0) + F.col("max_structuring_count") * 3.0), 1)
                     .alias("rule_score"),
                    F.col("max_structuring_count").alias("max_window_count")))
