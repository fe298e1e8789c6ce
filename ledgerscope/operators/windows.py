"""Time-range windows per key that stay parallel when one key is hot.

A plain ``Window.partitionBy(customer)`` puts all rows of a customer into one
task; if one customer holds a third of the table, so does one task. Here each
row is assigned to a time slice of its key and additionally copied, as a
narrow *context* row, into the next ``ceil(window / slice)`` slices. Every frame
``(t - window, t]`` then lies inside one ``(key, slice)`` partition, so the
window runs per (key, slice) and a hot key spreads over as many tasks as it has
slices. Context rows carry only the columns the frames read and are dropped
after the window, so the output has exactly the input rows.

For keys too dense even for that (many rows inside one frame length),
``prefix_rolling`` computes a frame as P(t) - P(t - w) from running totals in
fine slices plus per-slice offsets, with no copies. ``Params.rolling_strategy``
says which of the two is used; both give the same values, nulls included.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

US_PER_SECOND = 1_000_000
US_PER_HOUR = 3_600 * US_PER_SECOND
US_PER_DAY = 24 * US_PER_HOUR

SLICE_COL = "_slice"
T_COL = "_t_us"
SHIFT_COL = "_shift"

# (output name, frame length in microseconds, additive value per row: 1 for a count, the amount for a sum)
PrefixMeasure = tuple[str, int, Column]


def half_open_range(keys: Sequence[str], order_col: str, length_us: int):
    """Frame ``(t - length, t]`` on an integer microsecond order column, all peers included."""
    return Window.partitionBy(*keys).orderBy(order_col).rangeBetween(-(length_us - 1), 0)


def with_slices(df: DataFrame, ts_col: str, slice_us: int) -> DataFrame:
    """Adds the microsecond time and the time-slice number of each row."""
    return (df.withColumn(T_COL, F.unix_micros(F.col(ts_col)))
              .withColumn(SLICE_COL, F.floor(F.col(T_COL) / F.lit(int(slice_us))).cast("long")))


def slice_copies(df: DataFrame, keys: Sequence[str], ts_col: str, longest_us: int, read_cols: Sequence[str],
                 tiebreak: str | None = None, slice_us: int | None = None) -> DataFrame:
    """Rows with their time slice plus narrow context copies, hash-partitioned on (keys, slice).

    The explicit repartition is the one exchange of the rolling computation;
    every consumer partitioned by (keys, slice) (windows, per-slice summaries)
    reads it without another shuffle.
    """
    slice_us = int(slice_us or longest_us)
    copies = int(math.ceil(longest_us / slice_us))
    keep = set(keys) | set(read_cols) | {ts_col} | ({tiebreak} if tiebreak else set())
    base = with_slices(df, ts_col, slice_us)
    exploded = base.withColumn(SHIFT_COL, F.explode(
        F.when(F.col(T_COL).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(copies)))))  # no time, no later slice
    # Context copies keep only what the frames read; other columns become null
    # so the shuffle carries narrow rows for them.
    narrowed = exploded.select(
        *[F.col(c) if c in keep or c in (T_COL, SLICE_COL, SHIFT_COL)
          else F.when(F.col(SHIFT_COL) == 0, F.col(c)).alias(c) for c in exploded.columns]
    ).withColumn(SLICE_COL, F.col(SLICE_COL) + F.col(SHIFT_COL))
    return narrowed.repartition(*keys, SLICE_COL)


def rolling_on_slices(prepared: DataFrame, keys: Sequence[str], aggs: Sequence[PrefixMeasure], slice_us: int,
                      lag_cols: Sequence[tuple[str, str]] = (), tiebreak: str | None = None) -> DataFrame:
    """Rolling sums over the output of ``slice_copies``; returns the home rows only (``_slice`` kept). Nulls add nothing.

    A row's value enters at its time and leaves one frame length later, as a narrow row of its own within the same
    partition, so a sum is one running total: linear in the rows, however many lie in a frame. Floating-point values would
    leave rounding behind, so their frames are summed one by one.
    """
    part = [*keys, SLICE_COL]
    out = prepared
    order = [T_COL] + ([tiebreak] if tiebreak else [])
    if lag_cols:
        w_rows = Window.partitionBy(*part).orderBy(*order)
        for name, c in lag_cols:
            out = out.withColumn(name, F.lag(F.col(c)).over(w_rows))
    types = [f.dataType for f in prepared.select(*[v for _, _, v in aggs]).schema.fields]
    running = [(name, length, v, t) for (name, length, v), t in zip(aggs, types) if isinstance(t, (IntegralType, DecimalType))]
    for (name, length, v), t in zip(aggs, types):
        if not isinstance(t, (IntegralType, DecimalType)):
            out = out.withColumn(name, F.coalesce(F.sum(v).over(half_open_range(part, T_COL, length)), F.lit(0)))
    if running:
        rows = out.columns
        lengths = sorted({length for _, length, _, _ in running})
        until = (F.col(SLICE_COL) + 1) * F.lit(int(slice_us))  # what leaves later is seen by no home row
        leaves = [F.when(F.col(T_COL) + F.lit(int(x)) < until, F.lit(j)) for j, x in enumerate(lengths, 1)]
        out = out.select(*rows, *[F.coalesce(v, F.lit(0).cast(t)).alias(f"_v{i}") for i, (_, _, v, t) in enumerate(running)],
                         F.explode(F.array_compact(F.array(F.lit(0), *leaves))).alias("_j"))
        home = F.col("_j") == 0
        signed = [F.when(home, F.col(f"_v{i}")).when(F.col("_j") == lengths.index(length) + 1, -F.col(f"_v{i}")).otherwise(F.lit(0).cast(t)).alias(f"_v{i}")
                  for i, (_, length, _, t) in enumerate(running)]
        time = F.col(T_COL) + F.when(home, F.lit(0)).otherwise(F.element_at(F.array(*[F.lit(int(x)) for x in lengths]), F.greatest(F.col("_j"), F.lit(1))))
        out = out.select(*[F.col(c) if c in part else time.alias(c) if c == T_COL else F.when(home, F.col(c)).alias(c) for c in rows], *signed, "_j")
        upto = Window.partitionBy(*part).orderBy(T_COL).rangeBetween(Window.unboundedPreceding, 0)
        for i, (name, *_) in enumerate(running):
            out = out.withColumn(name, F.sum(f"_v{i}").over(upto))
        out = out.where(home).drop("_j", *[f"_v{i}" for i in range(len(running))])
    return out.filter(F.col(SHIFT_COL) == 0).drop(SHIFT_COL)


def sliced_rolling(df: DataFrame, keys: Sequence[str], ts_col: str, aggs: Sequence[PrefixMeasure],
                   read_cols: Sequence[str], lag_cols: Sequence[tuple[str, str]] = (),
                   tiebreak: str | None = None, slice_us: int | None = None) -> DataFrame:
    """Add rolling range sums (and optional previous-row values) per key.

    ``read_cols``: columns the frames read (kept on context rows).
    ``lag_cols``: (output name, column) pairs for the previous row's value in
    (time, tiebreak) order; null when the previous row lies more than
    ``ceil(window/slice)`` slices back (callers complete it, see features).
    The result keeps ``_slice`` (home slice) and ``_t_us``; callers drop them.
    """
    longest = max(length for _, length, _ in aggs)
    prepared = slice_copies(df, keys, ts_col, longest, read_cols, tiebreak, slice_us)
    return rolling_on_slices(prepared, keys, aggs, int(slice_us or longest), lag_cols, tiebreak)


def last_marker_at_or_before(df: DataFrame, keys: Sequence[str], order_col: str, marker: Column,
                             out: str, block: int = 1024) -> DataFrame:
    """For each row, the largest ``order_col`` value of a marker row at or before it within its key.

    Two levels so a hot key is not one task: a running max inside
    (key, block of ``block`` positions), completed from a per-block summary
    (one row per key and block) for rows whose block has no earlier marker.
    """
    blk = F.floor(F.col(order_col) / F.lit(block)).cast("long")
    m = F.when(marker, F.col(order_col))
    base = df.withColumn("_blk", blk).withColumn("_m", m)
    w_in = Window.partitionBy(*keys, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    inside = base.withColumn("_in", F.max("_m").over(w_in))
    per_block = base.groupBy(*keys, "_blk").agg(F.max("_m").alias("_bm"))
    w_prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(*keys, "_blk", F.max("_bm").over(w_prev).alias("_carry"))
    return (inside.join(carry, [*keys, "_blk"], "left")
            .withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))).drop("_blk", "_m", "_in", "_carry"))


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, block_col: str | None = None,
                  block: int = 1024) -> DataFrame:
    """Top ``n`` rows per key by ``order`` in two stages (per key and block, then per key).

    The first stage splits a hot key over blocks of its ``block_col`` values and
    keeps at most ``n`` rows per block, so the second stage sees a bounded set.
    """
    if block_col is not None:
        b = df.withColumn("_tb", F.floor(F.col(block_col) / F.lit(block)))
        w1 = Window.partitionBy(*keys, "_tb").orderBy(*order)
        df = b.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_tb", "_r1")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= n)


def prefix_rolling(df: DataFrame, keys: Sequence[str], ts_col: str, id_col: str, measures: Sequence[PrefixMeasure],
                   slice_us: int, prev_time: str | None = None) -> DataFrame:
    """Rolling sums over ``(t - w, t]`` as prefix differences, for keys too dense for overlapping slices.

    value(t) = P(t) - P(t - w), where P(x) is the key's running total of rows
    with time <= x. P is a per-slice offset (prefix over the small per-slice
    table) plus a running sum inside the slice. Every row becomes one data
    point and one narrow query point per distinct frame length, all routed to
    the time slice they fall in, so the slice length can be as fine as needed
    whatever the frame length: a hot key spreads over many tasks at a constant
    1 + (frame lengths) narrow points per row. The per-row results return by
    one join on (keys, time, id); ``id_col`` must identify a row within key and time.
    ``prev_time``: also return the previous row's time in (time, id) order.
    Returns (keys, ``_t_us``, id, measures..., prev) rows, one per input row.
    """
    lengths = sorted({m[1] for m in measures})
    vcols = [f"_v{i}" for i in range(len(measures))]
    base = with_slices(df, ts_col, slice_us).select(
        *keys, F.col(T_COL).alias("_t0"), F.col(id_col).alias("_id"),
        *[F.coalesce(m[2], F.lit(0)).alias(v) for m, v in zip(measures, vcols)])
    # j = -1: the data point itself; j >= 0: the query point t - lengths[j]
    pts = base.withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(len(lengths) - 1))))
    shift = F.element_at(F.array(*[F.lit(int(x)) for x in lengths]), (F.col("_j") + 1).cast("int"))
    is_data = F.col("_j") == -1
    pts = pts.select(*keys, "_t0", "_id", "_j",
                     F.when(is_data, F.col("_t0")).otherwise(F.col("_t0") - shift).alias(T_COL),
                     *[F.when(is_data, F.col(v)).otherwise(F.lit(0)).alias(v) for v in vcols])
    pts = pts.withColumn(SLICE_COL, F.floor(F.col(T_COL) / F.lit(int(slice_us))).cast("long")) \
        .repartition(*keys, SLICE_COL)
    upto = Window.partitionBy(*keys, SLICE_COL).orderBy(T_COL).rangeBetween(Window.unboundedPreceding, 0)
    for v in vcols:
        pts = pts.withColumn(f"{v}_run", F.sum(v).over(upto))
    if prev_time:
        before = Window.partitionBy(*keys, SLICE_COL).orderBy(T_COL, "_j", "_id") \
            .rowsBetween(Window.unboundedPreceding, -1)
        pts = pts.withColumn("_lag_t", F.last(F.when(F.col("_j") == -1, F.col(T_COL)), ignorenulls=True).over(before))
    # Offsets: totals of all earlier slices, over a per-(key, slice) table that lists every slice a
    # point falls in (empty ones too). Both inputs are partial aggregates: small next to the rows.
    per = base.withColumn(SLICE_COL, F.floor(F.col("_t0") / F.lit(int(slice_us))).cast("long")) \
        .groupBy(*keys, SLICE_COL).agg(*[F.sum(v).alias(f"{v}_tot") for v in vcols],
                                       F.max("_t0").alias("_slice_last"))
    needed = pts.select(*keys, SLICE_COL).distinct()
    tbl = join_rows(needed, per, [*keys, SLICE_COL])
    earlier = Window.partitionBy(*keys).orderBy(SLICE_COL).rowsBetween(Window.unboundedPreceding, -1)
    offs = tbl.select(*keys, SLICE_COL, *[F.coalesce(F.sum(f"{v}_tot").over(earlier), F.lit(0)).alias(f"{v}_off")
                                          for v in vcols],
                      F.max("_slice_last").over(earlier).alias("_prev_slice_last"))
    allp = join_rows(pts, offs, [*keys, SLICE_COL])
    prefix = {v: F.col(f"{v}_off") + F.col(f"{v}_run") for v in vcols}
    value_at = allp.select(*keys, "_t0", "_id", "_j", *[prefix[v].alias(v) for v in vcols],
                           *([F.coalesce("_lag_t", "_prev_slice_last").alias("_prev")] if prev_time else []))
    aggs = []
    for (name, length, _), v in zip(measures, vcols):
        j = lengths.index(length)
        # rows without a time are peers of each other, and nothing lies before their frame
        start = F.when(F.col("_t0").isNull(), F.lit(0)).otherwise(F.max(F.when(F.col("_j") == j, F.col(v))))
        aggs.append((F.max(F.when(F.col("_j") == -1, F.col(v))) - start).alias(name))
    if prev_time:
        aggs.append(F.max(F.when(F.col("_j") == -1, F.col("_prev"))).alias(prev_time))
    return value_at.groupBy(*keys, F.col("_t0").alias(T_COL), F.col("_id").alias(id_col)).agg(*aggs)


def slice_partials(df: DataFrame, keys: Sequence[str], ts_col: str, slice_us: int,
                   value_col: str | None = None) -> DataFrame:
    """Per (keys, slice): row count, latest time and, for ``value_col``, its non-null count, mean and squared deviations.

    A grouped aggregate, partial before its shuffle: small next to the rows.
    """
    aggs = [F.count(F.lit(1)).alias("_n"), F.max(T_COL).alias("_last_t")]
    if value_col:
        v = F.col(value_col).cast("double")
        aggs += [F.count(v).alias("_n_values"), F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_m2")]
    return with_slices(df, ts_col, slice_us).groupBy(*keys, SLICE_COL).agg(*aggs)


def rolling_strategy(longest_us: int, params) -> tuple[str, int]:
    """(strategy, slice length in microseconds) for rolling frames up to ``longest_us``, from the parameters alone."""
    if params.rolling_strategy not in ("slices", "prefix"):
        raise ValueError("rolling_strategy is slices or prefix")
    default = longest_us if params.rolling_strategy == "slices" else US_PER_DAY
    return params.rolling_strategy, int(params.time_slice_days * US_PER_DAY) if params.time_slice_days else default


def join_rows(rows: DataFrame, values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``values``, matched null-safely on ``cols``; no row is lost."""
    renamed = values.select(*[F.col(c).alias(f"_k_{c}") for c in cols], *[c for c in values.columns if c not in cols])
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(renamed, on, "left").drop(*[f"_k_{c}" for c in cols])


def rolling_sums(df: DataFrame, keys: Sequence[str], ts_col: str, id_col: str, measures: Sequence[PrefixMeasure],
                 params) -> DataFrame:
    """``df`` with additive rolling sums over ``(t - w, t]`` per key; nulls add nothing, so a sum is never null."""
    longest = max(m[1] for m in measures)
    strategy, slice_us = rolling_strategy(longest, params)
    if strategy == "prefix":
        r = prefix_rolling(df, keys, ts_col, id_col, measures, slice_us)
        return join_rows(df.withColumn(T_COL, F.unix_micros(F.col(ts_col))), r, [*keys, T_COL, id_col]).drop(T_COL)
    read = sorted({c for m in measures for c in _columns_of(m[2], df)} | {id_col})
    return sliced_rolling(df, keys, ts_col, aggs=measures, read_cols=read, slice_us=slice_us).drop(SLICE_COL, T_COL)


def _columns_of(c: Column, df: DataFrame) -> list[str]:
    """Input columns a measure reads (context copies must keep them)."""
    text = str(c)
    return [name for name in df.columns if name in text]
