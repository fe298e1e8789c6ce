"""Customer-level scores: min-max scaling, threshold flags, feature tags, entity and aggregation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global

from ledgerscope.params import DEFAULT_PARAMS, Params


def minmax_scale(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    """``(x - min) / (max - min)`` over the whole table; 0 when constant.

    The global min/max is a one-row aggregate, so broadcasting it is bounded.
    """
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    x = F.col(col).cast("double")
    return (attach_global(df, mm)
            .withColumn(out, F.when(F.col("_mx") > F.col("_mn"), (x - F.col("_mn")) / (F.col("_mx") - F.col("_mn")))
                        .otherwise(F.lit(0.0)))
            .drop("_mn", "_mx"))


def feature_tags(df: DataFrame, params: Params = DEFAULT_PARAMS) -> F.Column:
    """Conditional tags: z > 3, 7-day count > 10, max amount > large amount; default tag otherwise."""
    tags = F.array_compact(F.array(
        F.when(F.col("max_zscore") > 3.0, F.lit("high_amount_zscore")),
        F.when(F.col("max_rolling_7d_count") > 10, F.lit("high_transaction_velocity")),
        F.when(F.col("amount_max") > params.large_amount, F.lit("extreme_transaction_amount"))))
    return F.when(F.size(tags) == 0, F.array(F.lit("multivariate_statistical_outlier"))).otherwise(tags)


def score_threshold_flag(scored: DataFrame, params: Params = DEFAULT_PARAMS, score_col: str = "score") -> DataFrame:
    """Model hits: customers with score >= threshold, score to 3 dp, tags.

    ``enough_customers`` is false when fewer than ``ml_min_customers`` were scored: such a score says little, and
    the reader decides; no hit is dropped for it.
    """
    n = scored.agg(F.count(F.lit(1)).alias("_n"))
    return (attach_global(scored, n)
            .filter(F.col(score_col) >= params.ml_score_threshold)
            .select("customer_id", F.round(F.col(score_col), 3).alias("ml_score"),
                    F.lit(True).alias("anomaly_flag"), feature_tags(scored, params).alias("top_features"),
                    (F.col("_n") >= params.ml_min_customers).alias("enough_customers")))


def score_aggregation(agg: DataFrame) -> DataFrame:
    """``min(95, 40 + 4 * count)``."""
    return agg.withColumn("risk_score_raw", F.least(F.lit(95.0), 40.0 + 4.0 * F.col("transaction_count")))
