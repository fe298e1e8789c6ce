"""Grouped and global aggregates of transactions and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global


def agg_customer(txn: DataFrame, min_count: int | None = None) -> DataFrame:
    """Per customer: transaction count, total, mean; HAVING count >= min (default 1)."""
    m = 1 if min_count is None else min_count
    return (txn.groupBy("customer_id")
            .agg(F.count("transaction_id").alias("transaction_count"),
                 F.sum("amount").cast("double").alias("total_amount"),
                 F.avg(F.col("amount").cast("double")).alias("avg_amount"))
            .filter(F.col("transaction_count") >= m))


def top_customers(agg: DataFrame, n: int, by: str = "transaction_count") -> DataFrame:
    """Top n by a measure, ties by customer id (TakeOrderedAndProject: per-task top n, then merge)."""
    return agg.orderBy(F.col(by).desc(), F.col("customer_id").asc()).limit(n)


def middle_bounds(values: DataFrame, accuracy: int) -> tuple[float, float] | None:
    """Two values between which the middle of ``_v`` lies, from a mergeable quantile sketch (two numbers to the driver).

    The sketch's ranks are off by at most one in ``accuracy`` rows, and the bounds are taken two off the middle.
    """
    off = 2.0 / accuracy
    r = values.agg(F.percentile_approx("_v", [0.5 - off, 0.5 + off], accuracy).alias("q")).first()
    return None if r.q is None else (r.q[0], r.q[1])


def exact_median(df: DataFrame, col: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median of a column as a one-row table; null on empty input.

    A quantile sketch bounds the middle (one pass); a second pass counts the rows below and the distinct values inside,
    about 4 in ``accuracy`` of the rows, and only these are shuffled, written and ordered. Popular values are one row a task.
    The values inside are range-partitioned; the totals of the partitions (one row each) say how many rows lie before
    a partition, so the running count gives every value its first and last position; the values that hold the one or
    two middle positions are averaged. An action: small tables are written while the plan is built.
    """
    from ledgerscope.session import cut_lineage

    values = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    bounds = middle_bounds(values, accuracy)
    if bounds is None:
        return values.agg(F.max("_v").alias("median"))

    def split(low: float, high: float) -> tuple[DataFrame, int, int, int]:
        """(distinct values inside with their counts, rows below, inside and in all); rows outside are two groups."""
        side = F.when(F.col("_v") < low, -1).when(F.col("_v") > high, 1).otherwise(0)
        counts = cut_lineage(values.groupBy(side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
        rows = {r["_side"]: r["n"] for r in counts.groupBy("_side").agg(F.sum("_c").alias("n")).collect()}  # three rows
        return counts.where("_side = 0").select("_v", "_c"), rows.get(-1, 0), rows.get(0, 0), sum(rows.values())

    inside, below, held, n = split(*bounds)
    low, high = (n + 1) // 2, n // 2 + 1
    if not below < low <= high <= below + held:  # the sketch missed: take all values
        inside, below, held, n = split(float("-inf"), float("nan"))
    dealt = cut_lineage(inside.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum("_c").alias("_in_part"))
    before = parts.select("_part", (F.sum("_in_part").over(Window.orderBy("_part")) - F.col("_in_part") + F.lit(below)).alias("_before"))
    upto = Window.partitionBy("_part").orderBy("_v")
    placed = dealt.join(before, "_part").withColumn("_last", F.col("_before") + F.sum("_c").over(upto))
    holds = lambda p: ((F.col("_last") >= p) & (F.col("_last") - F.col("_c") < p)).cast("int")
    weight = holds(low) + holds(high)
    return placed.agg((F.sum(F.col("_v") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("median"))


def agg_summary(txn: DataFrame) -> DataFrame:
    """Count, volume, mean and exact median of amount (rounded 2); zero row on empty input."""
    a = F.col("amount").cast("double")
    base = txn.agg(F.count(F.lit(1)).alias("total_transactions"),
                   F.coalesce(F.round(F.sum("amount").cast("double"), 2), F.lit(0.0)).alias("total_volume"),
                   F.coalesce(F.round(F.avg(a), 2), F.lit(0.0)).alias("mean_amount"))
    med = exact_median(txn, "amount")  # one row
    return attach_global(base, med).select("total_transactions", "total_volume", "mean_amount",
                                      F.coalesce(F.round("median", 2), F.lit(0.0)).alias("median_amount"))


def agg_summary_approx(txn: DataFrame, accuracy: int = 10000) -> DataFrame:
    """As ``agg_summary`` with a bounded-memory approximate median for very large inputs."""
    a = F.col("amount").cast("double")
    return txn.agg(F.count(F.lit(1)).alias("total_transactions"),
                   F.round(F.sum("amount").cast("double"), 2).alias("total_volume"),
                   F.round(F.avg(a), 2).alias("mean_amount"),
                   F.round(F.percentile_approx(a, 0.5, accuracy), 2).alias("median_amount"))


def agg_type_counts(txn: DataFrame) -> DataFrame:
    return (txn.filter(F.col("transaction_type").isNotNull()).groupBy("transaction_type")
            .agg(F.count(F.lit(1)).alias("n")))


def agg_daily(txn: DataFrame) -> DataFrame:
    return (txn.groupBy(F.to_date("timestamp").alias("date"))
            .agg(F.sum("amount").cast("double").alias("amount"), F.count(F.lit(1)).alias("transaction_count")))


def agg_histogram(txn: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of amount with empty bins kept.

    Global min/max is a one-row aggregate (bounded broadcast); bin numbers are a
    sequence of ``bins`` values joined to the counts.
    """
    a = F.col("amount").cast("double")
    mm = txn.agg(F.min(a).alias("_lo"), F.max(a).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((a - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    counts = attach_global(txn, mm).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = mm.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    return (all_bins.join(counts, "bin", "left")
            .select("bin",
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_end"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def agg_risk_breakdown(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def agg_kpis(txn: DataFrame, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("customer_id") if approx else F.count_distinct("customer_id")
    return txn.agg(F.count(F.lit(1)).alias("total_transactions"),
                   F.sum("amount").cast("double").alias("total_volume"),
                   F.avg(F.col("amount").cast("double")).alias("avg_amount"),
                   distinct.alias("unique_customers"))


def agg_customer_features(features: DataFrame) -> DataFrame:
    """Seven model features per customer; nulls -> 0.

    With ``structuring_window_count`` present (see ``compute_features``) the
    same aggregation also yields the structuring statistics: just-under row
    count and total, and the largest rolling count among just-under rows.
    """
    extra = []
    if "structuring_window_count" in features.columns:
        ju = F.col("is_just_under_threshold")
        extra = [F.count_if(ju).alias("n_just_under"),
                 F.sum(F.when(ju, F.col("amount"))).alias("just_under_total"),
                 F.max(F.when(ju, F.col("structuring_window_count"))).alias("max_structuring_count")]
    f = (features.groupBy("customer_id")
         .agg(F.avg(F.col("amount").cast("double")).alias("amount_mean"),
              F.max(F.col("amount").cast("double")).alias("amount_max"),
              F.sum("amount").cast("double").alias("amount_sum"),
              F.max("rolling_7d_count").cast("double").alias("max_rolling_7d_count"),
              F.max("rolling_30d_sum").alias("max_rolling_30d_sum"),
              F.max("amount_zscore_vs_customer_avg").alias("max_zscore"),
              F.min("velocity_hours_since_last_txn").alias("min_velocity_hours"),
              F.count("transaction_id").alias("n_txn"), *extra))
    return f.na.fill(0.0, subset=FEATURE_VECTOR)


FEATURE_VECTOR = ["amount_mean", "amount_max", "amount_sum", "max_rolling_7d_count", "max_rolling_30d_sum",
                  "max_zscore", "min_velocity_hours"]


def agg_entity_profile(txn: DataFrame, customers: DataFrame) -> DataFrame:
    """Profile of requested customers: count, volume, mean, max (semi-join first)."""
    rows = txn.join(customers.select("customer_id"), "customer_id", "left_semi")
    return rows.groupBy("customer_id").agg(
        F.count("transaction_id").alias("transactions_count"),
        F.round(F.sum("amount").cast("double"), 2).alias("total_volume"),
        F.round(F.avg(F.col("amount").cast("double")), 2).alias("avg_amount"),
        F.max(F.col("amount").cast("double")).alias("max_amount"))


def agg_feedback(feedback: DataFrame) -> DataFrame:
    """True / False Positive counts and the false-positive ratio (null when there is no verdict)."""
    tp = F.count_if(F.col("feedback") == "True Positive")
    fp = F.count_if(F.col("feedback") == "False Positive")
    return (feedback.agg(tp.alias("true_positives"), fp.alias("false_positives"))
            .withColumn("total", F.col("true_positives") + F.col("false_positives"))
            .withColumn("fp_ratio", F.when(F.col("total") > 0, F.col("false_positives") / F.col("total"))))


def agg_confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2x2 confusion matrix as counts tn, fp, fn, tp."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return pred.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                    F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def eval_binary(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 (0 on zero division, 3 dp) and the confusion counts."""
    c = agg_confusion(pred, label, prediction)
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    c = c.withColumn("_p", prec).withColumn("_r", rec)
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))) \
        .otherwise(0.0)
    return c.select("tn", "fp", "fn", "tp", F.round("_p", 3).alias("precision"), F.round("_r", 3).alias("recall"),
                    F.round(f1, 3).alias("f1_score"), (F.col("tp") + F.col("fn")).alias("positives"),
                    (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("total_samples"))


def agg_run_totals(flagged: DataFrame, evidence: DataFrame, scanned: DataFrame) -> DataFrame:
    """Flagged entities, distinct evidence ids, scanned rows, evaluated customers (one row; ids: ``flagged_ids``)."""
    f = flagged.agg(F.count_distinct("customer_id").alias("flagged_entities"))
    e = evidence.agg(F.count_distinct("transaction_id").alias("evidence_ids"))
    s = scanned.agg(F.count(F.lit(1)).alias("scanned_rows"),
                    F.count_distinct("customer_id").alias("evaluated_customers"))
    return attach_global(attach_global(f, e), s).select("flagged_entities", "evidence_ids", "scanned_rows", "evaluated_customers")


def flagged_ids(flagged: DataFrame) -> DataFrame:
    """The flagged customers, one row each, however many they are."""
    return flagged.select("customer_id").where("customer_id is not null").distinct()


def daily_counts(txn: DataFrame) -> DataFrame:
    """Transactions per customer per calendar day (grouped, partial-aggregated)."""
    return (txn.groupBy("customer_id", F.to_date("timestamp").alias("date"))
            .agg(F.count(F.lit(1)).alias("daily_txn_count"), F.sum("amount").cast("double").alias("daily_amount")))


def daily_burst(txn: DataFrame, min_count: int) -> DataFrame:
    """Customer-days with at least ``min_count`` transactions."""
    return daily_counts(txn).filter(F.col("daily_txn_count") >= min_count)


def win_train_split(df: DataFrame, frac: float = 0.7, order=("customer_id", "timestamp", "transaction_id")) -> DataFrame:
    """Positional split after a global sort: the first floor(frac * n) rows are train.

    Positions come from ``global_row_index`` (range partitioning, local
    numbering, per-partition offsets), never from a single-partition window.
    """
    from ledgerscope.sources.files import global_row_index

    ranked = global_row_index(df, list(order), "row_index", start=1)
    n = ranked.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return (attach_global(ranked, n)
            .withColumn("is_train", F.col("row_index") <= F.floor(F.col("_total") * frac))
            .drop("_total"))
