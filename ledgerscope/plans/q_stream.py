"""Registered streaming queries: each runs its stream with ``availableNow`` into a file sink and reads it back.

Append mode emits only windows and sessions the watermark has closed; the
oracles select exactly those from the batch equivalent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.plans.q_core import FIX
from ledgerscope.plans.registry import register
from ledgerscope.plans.sqlviews import TXN_CTE, with_ctes
from ledgerscope.sources.files import scratch_path
from ledgerscope.streaming import jobs


def _state_partitions(spark) -> int:
    try:
        return max(1, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _run(spark, df, name, fmt="parquet"):
    """Each registered stream starts on a fresh checkpoint with one state partition per core."""
    out = scratch_path(spark, f"stream-{name}")
    jobs.run_available_now(df, f"{out}/data", f"{out}/_checkpoint", fmt=fmt,
                           state_partitions=_state_partitions(spark))
    return out


DELIVERIES = 5


def _chunks(spark, sf, n: int = DELIVERIES, jitter_us: int = 0):
    """The events in ``n`` chunks of equal length of time, the oldest first (stand-in deliveries of a stream).

    ``jitter_us``: each row is delivered up to that much later than its time, so that chunks overlap in event time.
    """
    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = ev.agg(F.min(us), F.max(us)).first()
    if lo is None:
        return [ev]
    at = us + F.pmod(F.xxhash64("event_id"), F.lit(jitter_us)) if jitter_us else us
    part = F.least(F.floor((at - lo) * n / (hi - lo + 1)), F.lit(n - 1))
    return [ev.where(part == i) for i in range(n)]


def _delivered(spark, sf, name, chunks):
    """The chunks written one after the other, as a stream that takes the files of about one chunk a micro-batch."""
    src = scratch_path(spark, f"deliveries-{name}")
    for chunk in chunks:
        chunk.write.mode("append").parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    return jobs.events_stream(spark, sf, path=src, max_files=-(-files // len(chunks)))


def _run_deliveries(spark, sf, name, job, chunks=None, rocksdb=False):
    """The job over a stream whose rows arrive in several deliveries; one start takes them in turn."""
    from ledgerscope.sources.tables import txn_from_events
    out = scratch_path(spark, f"stream-{name}")
    stream = txn_from_events(_delivered(spark, sf, name, _chunks(spark, sf) if chunks is None else chunks), spark, sf)
    jobs.run_available_now(job(stream), f"{out}/data", f"{out}/_checkpoint", state_partitions=_state_partitions(spark), rocksdb=rocksdb)
    return out


@register("stream_spike_alerts", with_ctes(
    "SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, customer_id, CAST(amount AS DOUBLE) AS amount, "
    "'Sudden volume spike detected in stream' AS reason, transaction_id FROM txn WHERE amount > 10000", TXN_CTE))
def q_stream_spike_alerts(spark, sf):
    out = _run(spark, jobs.spike_alerts(jobs.txn_stream(spark, sf)), "spikes")
    return spark.read.parquet(f"{out}/data").select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "customer_id", "amount", "reason",
        "transaction_id")


@register("stream_alert_sink", with_ctes("SELECT count(*) AS alerts, count(DISTINCT transaction_id) AS ids "
                                         "FROM txn WHERE amount > 10000", TXN_CTE))
def q_stream_alert_sink(spark, sf):
    """JSON-lines alert sink; the stream is started twice on one checkpoint and writes each alert once."""
    out = scratch_path(spark, "stream-alert-sink")
    for _ in range(2):
        jobs.run_available_now(jobs.spike_alerts(jobs.txn_stream(spark, sf)), f"{out}/data", f"{out}/_checkpoint",
                               fmt="json", state_partitions=_state_partitions(spark))
    a = spark.read.schema("transaction_id STRING, customer_id STRING, amount DOUBLE").json(f"{out}/data")
    return a.agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("transaction_id").alias("ids"))


_HF_SQL = with_ctes("""SELECT window_start, window_end, customer_id, count(*) AS txn_count,
  round(CAST(sum(amount) AS DOUBLE), 2) AS amount FROM (
  SELECT date_trunc('day', timestamp) AS window_start, date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end,
         customer_id, amount FROM tr) w
WHERE window_end <= (SELECT max(timestamp) FROM tr) - INTERVAL 1 HOUR
GROUP BY 1, 2, 3 HAVING count(*) >= 2""", TXN_CTE, "tr AS (SELECT * FROM txn WHERE transaction_type = 'transfer')")


@register("stream_high_frequency", _HF_SQL)
def q_stream_high_frequency(spark, sf):
    out = _run_deliveries(spark, sf, "hf", lambda txn: jobs.high_frequency(txn, 2, "1 day", None, "1 hour"))
    r = spark.read.parquet(f"{out}/data")
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "customer_id", "txn_count",
                    F.round("amount", 2).alias("amount"))


_HF_SLIDE_SQL = with_ctes("""SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, customer_id,
  count(*) AS txn_count, round(CAST(sum(amount) AS DOUBLE), 2) AS amount FROM (
  SELECT unnest(generate_series(date_trunc('hour', timestamp) - INTERVAL 23 HOUR, date_trunc('hour', timestamp),
                                INTERVAL 1 HOUR)) AS window_start, customer_id, amount FROM tr) w
WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(timestamp) FROM tr) - INTERVAL 1 HOUR
GROUP BY 1, 2, 3 HAVING count(*) >= 3""", TXN_CTE, "tr AS (SELECT * FROM txn WHERE transaction_type = 'transfer')")


@register("stream_high_frequency_sliding", _HF_SLIDE_SQL)
def q_stream_high_frequency_sliding(spark, sf):
    df = jobs.high_frequency(jobs.txn_stream(spark, sf), 3, "24 hours", "1 hour", "1 hour")
    out = _run(spark, df, "hf-slide")
    r = spark.read.parquet(f"{out}/data")
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "customer_id", "txn_count",
                    F.round("amount", 2).alias("amount"))


_SESS_SQL = with_ctes("""SELECT min(timestamp) AS session_start, max(timestamp) + INTERVAL 2 HOUR AS session_end,
  customer_id, count(*) AS txn_count, round(CAST(sum(amount) AS DOUBLE), 2) AS amount FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR timestamp >= prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END)
              OVER (PARTITION BY customer_id ORDER BY timestamp, transaction_id) AS sid FROM (
    SELECT *, lag(timestamp) OVER (PARTITION BY customer_id ORDER BY timestamp, transaction_id) AS prev FROM txn) a) b
GROUP BY customer_id, sid
HAVING max(timestamp) + INTERVAL 2 HOUR <= (SELECT max(timestamp) FROM txn) - INTERVAL 1 HOUR""", TXN_CTE)


@register("stream_customer_sessions", _SESS_SQL)
def q_stream_customer_sessions(spark, sf):
    """Five deliveries that overlap by up to 40 minutes: sessions that a delivery cuts are carried on and closed later."""
    chunks = _chunks(spark, sf, jitter_us=2_400_000_000)
    out = _run_deliveries(spark, sf, "sessions", lambda txn: jobs.customer_sessions(txn, "2 hours", "1 hour"), chunks)
    r = spark.read.parquet(f"{out}/data")
    return r.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session_end").cast("timestamp_ntz").alias("session_end"), "customer_id", "txn_count",
                    F.round("amount", 2).alias("amount"))


@register("stream_dedup", with_ctes("SELECT DISTINCT transaction_id FROM txn", TXN_CTE))
def q_stream_dedup(spark, sf):
    """Every delivery comes twice (a replayed file); the stream keeps each transaction id once."""
    chunks = [c for chunk in _chunks(spark, sf) for c in (chunk.unionAll(chunk), chunk)]
    out = _run_deliveries(spark, sf, "dedup", lambda txn: jobs.dedup(txn).select("transaction_id"), chunks)
    return spark.read.parquet(f"{out}/data")


_STRUCT_STATE_SQL = with_ctes("""SELECT customer_id, make_timestamp(t) AS alert_time, cnt AS window_count,
  transaction_id FROM walk WHERE alerted AND t <= (SELECT (max(t) // 1000 - 86400000) * 1000 FROM jw)""", "RECURSIVE " + TXN_CTE, """jw AS (
  SELECT customer_id, transaction_id, epoch_us(timestamp) AS t,
         count(*) OVER (PARTITION BY customer_id ORDER BY epoch_us(timestamp)
                        RANGE BETWEEN {w_m1} PRECEDING AND CURRENT ROW) AS cnt,
         row_number() OVER (PARTITION BY customer_id ORDER BY timestamp, transaction_id) AS rn
  FROM txn WHERE amount >= {lo} AND amount < {hi})""", """walk(customer_id, rn, t, transaction_id, cnt, last_alert, alerted) AS (
  SELECT customer_id, rn, t, transaction_id, cnt, CASE WHEN cnt >= {min_count} THEN t END, cnt >= {min_count}
  FROM jw WHERE rn = 1
  UNION ALL
  SELECT j.customer_id, j.rn, j.t, j.transaction_id, j.cnt,
         CASE WHEN j.cnt >= {min_count} AND (w.last_alert IS NULL OR w.last_alert <= j.t - {w}) THEN j.t
              ELSE w.last_alert END,
         j.cnt >= {min_count} AND (w.last_alert IS NULL OR w.last_alert <= j.t - {w})
  FROM walk w JOIN jw j ON j.customer_id = w.customer_id AND j.rn = w.rn + 1)""",
    w=FIX.structuring_window_days * 86_400_000_000, w_m1=FIX.structuring_window_days * 86_400_000_000 - 1,
    lo=FIX.structuring_lower_bound, hi=FIX.structuring_threshold, min_count=FIX.structuring_min_count)


@register("stream_structuring", _STRUCT_STATE_SQL)
def q_stream_structuring(spark, sf):
    """Keyed-state structuring alerts (one per crossing of the minimum count), up to the last watermark."""
    out = _run_deliveries(spark, sf, "structuring", lambda txn: jobs.structuring_state(txn, FIX), rocksdb=True)
    r = spark.read.parquet(f"{out}/data")
    return r.select("customer_id", F.col("alert_time").cast("timestamp_ntz").alias("alert_time"), "window_count",
                    "transaction_id")


_LATE_SQL = """WITH e AS (SELECT epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events),
r AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
c AS (SELECT us, least(CAST(floor((us - lo) * 5.0 / (hi - lo + 1)) AS INTEGER), 4) AS chunk FROM e, r),
b AS (SELECT us, CASE chunk WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 ELSE 4 END AS batch FROM c),
m AS (SELECT batch, max(us) AS hi FROM b GROUP BY 1)
SELECT CAST(b.batch AS BIGINT) AS batch, count(*) AS input_rows,
  count(*) FILTER (WHERE us < (SELECT max(m.hi) FROM m WHERE m.batch < b.batch) - 3600000000) AS late_rows FROM b GROUP BY b.batch"""


@register("stream_late_data", _LATE_SQL)
def q_stream_late_data(spark, sf):
    """Five deliveries, the second and third and the fourth and fifth in the wrong order; late rows per batch, as observed."""
    from ledgerscope.sources.tables import txn_from_events
    chunks = _chunks(spark, sf)
    out = scratch_path(spark, "stream-late")
    stream = txn_from_events(_delivered(spark, sf, "late", [chunks[i] for i in (0, 2, 1, 4, 3)]), spark, sf)
    jobs.route_late_rows(stream.select("transaction_id", "customer_id", "timestamp"), "timestamp", 3_600_000_000, f"{out}/sorted",
                         f"{out}/_checkpoint")
    return jobs.late_batches(spark, f"{out}/sorted")


_DROPPED_SQL = """WITH e AS (SELECT epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events),
r AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
c AS (SELECT us, least(CAST(floor((us - lo) * 5.0 / (hi - lo + 1)) AS INTEGER), 4) AS chunk FROM e, r),
b AS (SELECT us, CASE chunk WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS batch FROM c),
m AS (SELECT batch, max(us) AS hi FROM b GROUP BY 1)
SELECT CAST(b.batch AS BIGINT) AS batch, count(*) AS input_rows,
  count(*) FILTER (WHERE us <= (SELECT max(m.hi) FROM m WHERE m.batch < b.batch - 1) // 1000 * 1000 - 3600000000) AS dropped_rows FROM b GROUP BY b.batch"""


@register("stream_dropped_rows", _DROPPED_SQL)
def q_stream_dropped_rows(spark, sf):
    """What the engine reports of a de-duplication whose second delivery comes after the fourth: rows in and dropped per batch.

    A stateful operator judges a batch by the watermark that the batch before ran with.
    """
    from ledgerscope.sources.tables import txn_from_events
    from ledgerscope.streaming.progress import hear
    chunks = _chunks(spark, sf)
    out = scratch_path(spark, "stream-dropped")
    stream = txn_from_events(_delivered(spark, sf, "dropped", [chunks[i] for i in (0, 2, 3, 1, 4)]), spark, sf)
    with hear(spark) as log:
        jobs.run_available_now(jobs.dedup(stream.select("transaction_id", "timestamp")), f"{out}/data", f"{out}/_checkpoint",
                               state_partitions=_state_partitions(spark))
    return log.table(spark).where("input_rows > 0").select("batch", "input_rows", "dropped_rows")


@register("sink_alert_stream", with_ctes(
    "SELECT strftime(CAST(timestamp AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, customer_id, "
    "CAST(amount AS DOUBLE) AS amount, 'Sudden volume spike detected in stream' AS reason FROM txn WHERE amount > 10000",
    TXN_CTE))
def q_sink_alert_stream(spark, sf):
    """Alert rows appended by the stream to a JSON-lines sink, read back as the alert log."""
    from ledgerscope.sources.files import TS_FORMAT, read_alerts
    alerts = jobs.spike_alerts(jobs.txn_stream(spark, sf)).select(
        F.date_format("timestamp", TS_FORMAT).alias("timestamp"), "customer_id", "event_type", "amount", "reason")
    out = _run(spark, alerts, "alert-log", fmt="json")
    return read_alerts(spark, f"{out}/data").select("timestamp", "customer_id", "amount", "reason")
