"""Per-transaction features: threshold flag, z-score, velocity, rolling count and sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.exprs import just_under
from ledgerscope.operators.windows import (SLICE_COL, T_COL, US_PER_DAY, US_PER_HOUR, join_rows, prefix_rolling,
                                           rolling_on_slices, rolling_strategy, rolling_sums, slice_copies,
                                           slice_partials)
from ledgerscope.params import DEFAULT_PARAMS, Params

FEATURE_COLUMNS = ["is_just_under_threshold", "amount_zscore_vs_customer_avg", "velocity_hours_since_last_txn",
                   "rolling_7d_count", "rolling_30d_sum"]


def customer_amount_stats(txn: DataFrame) -> DataFrame:
    """Mean and sample std of amount per customer; null or zero std becomes 1.

    A grouped aggregate: partial aggregation before the shuffle, so a hot
    customer costs one partial row per task, not one task.
    """
    std = F.stddev_samp(F.col("amount").cast("double"))
    return (txn.groupBy("customer_id")
               .agg(F.avg(F.col("amount").cast("double")).alias("amount_mean"), std.alias("_std"))
               .select("customer_id", "amount_mean",
                       F.when(F.col("_std").isNull() | (F.col("_std") == 0), F.lit(1.0))
                        .otherwise(F.col("_std")).alias("amount_std")))


def slice_summary(partials: DataFrame) -> DataFrame:
    """Per (customer, slice): latest time of the nearest earlier slice, and the customer's amount mean / std.

    ``partials``: per-slice count of amounts, mean and squared deviations (``slice_partials``
    with ``value_col="amount"``; rows without an amount count in neither). Mean and sample std are merged with Chan et
    al.'s formula on this small table; std null or 0 -> 1.
    """
    w_all = Window.partitionBy("customer_id")
    w_ord = w_all.orderBy(SLICE_COL)
    per = (partials.withColumn("_prev_slice_last_t", F.lag("_last_t").over(w_ord))
           .withColumn("_n_total", F.sum("_n_values").over(w_all))
           # a slice without amounts has no mean and weighs nothing
           .withColumn("amount_mean", F.sum(F.col("_n_values") * F.col("_m")).over(w_all) / F.nullif("_n_total", F.lit(0))))
    per = per.withColumn("_m2_total", F.sum(F.col("_m2") + F.col("_n_values") * F.pow(F.col("_m") - F.col("amount_mean"), 2)).over(w_all))
    std = F.when(F.col("_n_total") > 1, F.sqrt(F.greatest(F.col("_m2_total"), F.lit(0.0)) / (F.col("_n_total") - 1)))
    return per.select("customer_id", SLICE_COL, "_prev_slice_last_t", "amount_mean",
                      F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std).alias("amount_std"))


def _features_by_prefix(txn: DataFrame, p: Params, slice_us: int, structuring_count: bool,
                        partials: DataFrame) -> DataFrame:
    measures = [("rolling_7d_count", p.rolling_short_days * US_PER_DAY, F.lit(1)),
                ("rolling_30d_sum", p.rolling_long_days * US_PER_DAY, F.col("amount"))]
    if structuring_count:
        measures.append(("structuring_window_count", p.structuring_window_days * US_PER_DAY,
                         F.when(just_under(F.col("amount"), p), F.lit(1)).otherwise(F.lit(0))))
    r = prefix_rolling(txn, ["customer_id"], "timestamp", "transaction_id", measures, slice_us, prev_time="_prev_t")
    stats = (slice_summary(partials).groupBy("customer_id")
             .agg(F.first("amount_mean").alias("amount_mean"), F.first("amount_std").alias("amount_std")))
    rows = txn.withColumn(T_COL, F.unix_micros("timestamp"))
    out = (join_rows(join_rows(rows, r, ["customer_id", T_COL, "transaction_id"]), stats, ["customer_id"])
           .withColumn("rolling_30d_sum", F.col("rolling_30d_sum").cast("double"))
           .withColumn("_lag_t", F.col("_prev_t")).withColumn("_prev_slice_last_t", F.lit(None).cast("long")))
    if structuring_count:
        out = out.withColumn("structuring_window_count", F.col("structuring_window_count").cast("long"))
    return out


def compute_features(txn: DataFrame, params: Params = DEFAULT_PARAMS, keep_slice: bool = False,
                     structuring_count: bool = False) -> DataFrame:
    """The feature table: input rows plus the five feature columns.

    Rolling frames are half-open ``(t - w, t]`` and include all rows tied on
    ``t``; velocity takes the previous row in (time, transaction id) order.
    Strategy (``Params.rolling_strategy``): overlapping time slices, where one
    shuffle on (customer, slice) carries all windows; or, for customers too
    dense for that, prefix differences over fine slices. ``structuring_count=True`` adds
    ``structuring_window_count``: just-under rows in ``(t - structuring window, t]``, from the same window pass.

    Counts are of rows, null ids included; null amounts add nothing to sums, means and deviations; rows with a null
    time are peers of each other alone. The per-slice partials are written while the plan is built (one action).
    """
    p = params
    short_us = p.rolling_short_days * US_PER_DAY
    long_us = p.rolling_long_days * US_PER_DAY
    aggs = [("rolling_7d_count", short_us, F.lit(1)), ("rolling_30d_sum", long_us, F.col("amount"))]
    if structuring_count:
        ju = F.when(just_under(F.col("amount"), p), F.lit(1)).otherwise(F.lit(0))
        aggs.append(("structuring_window_count", p.structuring_window_days * US_PER_DAY, ju))
    from ledgerscope.session import cut_lineage

    longest = max(a[1] for a in aggs)
    strategy, slice_us = rolling_strategy(longest, p)
    # Per-(customer, slice) partials: a small table, written once; it gives the customer statistics and the
    # velocity fallback without another pass over the rows.
    partials = cut_lineage(slice_partials(txn.select("customer_id", "timestamp", "amount"), ["customer_id"],
                                          "timestamp", slice_us, "amount"))
    if strategy == "prefix":
        joined = _features_by_prefix(txn, p, slice_us, structuring_count, partials)
        keep_slice = False
    else:
        prepared = slice_copies(txn, ["customer_id"], "timestamp", longest,
                                ["amount", "transaction_id"], "transaction_id", slice_us)
        rolled = rolling_on_slices(prepared, ["customer_id"], aggs, slice_us, lag_cols=[("_lag_t", T_COL)],
                                   tiebreak="transaction_id").withColumn("rolling_30d_sum", F.col("rolling_30d_sum").cast("double"))
        joined = join_rows(rolled, slice_summary(partials), ["customer_id", SLICE_COL])
    prev_t = F.coalesce(F.col("_lag_t"), F.col("_prev_slice_last_t"))
    out = (joined
           .withColumn("is_just_under_threshold", just_under(F.col("amount"), p))
           .withColumn("amount_zscore_vs_customer_avg",
                       (F.col("amount").cast("double") - F.col("amount_mean"))
                       / (F.col("amount_std") + F.lit(p.zscore_epsilon)))
           .withColumn("velocity_hours_since_last_txn",
                       F.coalesce((F.col(T_COL) - prev_t).cast("double") / F.lit(float(US_PER_HOUR)),
                                  F.lit(p.velocity_missing_hours))))
    cols = (list(txn.columns) + FEATURE_COLUMNS + (["structuring_window_count"] if structuring_count else [])
            + ([SLICE_COL] if keep_slice else []))
    return out.select(*cols)


def rolling_features(txn: DataFrame, days: int, params: Params = DEFAULT_PARAMS, ties: str = "all") -> DataFrame:
    """Rolling count, sum and mean over ``(t - days, t]`` per customer.

    ``ties="all"``: every row tied on ``t`` is in the frame (deterministic).
    ``ties="ordered"``: tied rows see only peers ordered before them by
    transaction id (the behaviour of an index-based rolling window); the frame
    with all peers less what the later peers add. Null amounts add nothing, and the
    mean is over the rows of the frame that have an amount (null without any).
    """
    w_us = days * US_PER_DAY
    has = F.when(F.col("amount").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    r = rolling_sums(txn, ["customer_id"], "timestamp", "transaction_id",
                     [("rolling_count", w_us, F.lit(1)), ("rolling_sum", w_us, F.col("amount")), ("_amounts", w_us, has)], params)
    if ties == "ordered":
        # only rows of one instant meet in this window
        later = (Window.partitionBy("customer_id", "timestamp").orderBy(F.col("transaction_id").desc_nulls_first())
                 .rowsBetween(Window.unboundedPreceding, -1))
        over = lambda c: F.coalesce(F.sum(c).over(later), F.lit(0))
        r = (r.withColumn("_later_n", over(F.lit(1))).withColumn("_later_sum", over(F.col("amount"))).withColumn("_later_has", over(has))
             .withColumn("rolling_count", F.col("rolling_count") - F.col("_later_n"))
             .withColumn("rolling_sum", F.col("rolling_sum") - F.col("_later_sum"))
             .withColumn("_amounts", F.col("_amounts") - F.col("_later_has")).drop("_later_n", "_later_sum", "_later_has"))
    return (r.withColumn("rolling_count", F.col("rolling_count").cast("long"))
            .withColumn("rolling_sum", F.col("rolling_sum").cast("double"))
            .withColumn("rolling_avg", F.col("rolling_sum") / F.nullif("_amounts", F.lit(0))).drop("_amounts"))


def daily_txn_count(txn: DataFrame) -> DataFrame:
    """Each row with its customer's transaction count on that calendar day.

    Counted by a grouped aggregate (partial before the shuffle) and joined back
    on (customer, day), so one busy customer-day is not one window task.
    """
    day = F.to_date("timestamp")
    counts = txn.groupBy("customer_id", day.alias("_day")).agg(F.count(F.lit(1)).alias("daily_txn_count"))
    return (txn.withColumn("_day", day).join(counts, ["customer_id", "_day"], "left").drop("_day"))


def burst_24h(txn: DataFrame, min_count: int, params: Params = DEFAULT_PARAMS, hours: int = 24) -> DataFrame:
    """Customers reaching ``min_count`` transactions within ``(t - hours, t]``; largest such count and when.

    Rolling count, then a grouped aggregate.
    """
    r = rolling_sums(txn.select("customer_id", "timestamp", "transaction_id"), ["customer_id"], "timestamp",
                     "transaction_id", [("_c", hours * US_PER_HOUR, F.lit(1))], params)
    return (r.groupBy("customer_id")
            .agg(F.max("_c").cast("long").alias("max_24h_count"),
                 F.min(F.when(F.col("_c") >= min_count, F.col("timestamp"))).alias("first_reached"))
            .filter(F.col("max_24h_count") >= min_count))
