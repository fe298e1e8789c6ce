"""Streaming alerts: stateless spikes, windowed frequency, sessions, keyed structuring state, de-duplication.

Every job is a ``readStream`` plan with an event-time watermark; state is
bounded by the watermark (windows and sessions close, keyed state times out)
and the file sinks are exactly-once through their checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerscope.params import DEFAULT_PARAMS, Params
from ledgerscope.sources.tables import table, txn_from_events
from ledgerscope.streaming.keyed import ALERT_SCHEMA, StructuringProcessor


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, path: str | None = None) -> DataFrame:
    """The events table read as a file stream (schema taken from the batch table)."""
    schema = table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if path is None:
        return r.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return r.parquet(path)


def txn_stream(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return txn_from_events(events_stream(spark, sf_dir, **kw), spark, sf_dir)


# Alert event type and reasons of the alert log.
ALERT_EVENT_TYPE = "STREAM_ALERT"
SPIKE_REASON = "Sudden volume spike detected in stream"
FREQUENCY_REASON = "High frequency transfer pattern"


def spike_alerts(txn: DataFrame, limit: float = 10000.0) -> DataFrame:
    """Stateless: every transaction above ``limit`` becomes an alert row with its reason."""
    return txn.filter(F.col("amount") > F.lit(limit)).select(
        "timestamp", "customer_id", F.lit(ALERT_EVENT_TYPE).alias("event_type"),
        F.col("amount").cast("double").alias("amount"),
        F.lit(SPIKE_REASON).alias("reason"), "transaction_id")


def high_frequency(txn: DataFrame, min_count: int, window: str = "1 day", slide: str | None = None,
                   delay: str = "1 hour", txn_type: str | None = "transfer") -> DataFrame:
    """Count per customer and event-time window (tumbling or sliding); windows with >= ``min_count``."""
    t = txn if txn_type is None else txn.filter(F.col("transaction_type") == txn_type)
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return (t.withWatermark("timestamp", delay)
            .groupBy(w.alias("w"), "customer_id")
            .agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").cast("double").alias("amount"))
            .filter(F.col("txn_count") >= min_count)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "customer_id",
                    "txn_count", "amount", F.lit(FREQUENCY_REASON).alias("reason")))


def customer_sessions(txn: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Activity bursts per customer: session windows closed by a gap of inactivity."""
    return (txn.withWatermark("timestamp", delay)
            .groupBy(F.session_window("timestamp", gap).alias("s"), "customer_id")
            .agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").cast("double").alias("amount"))
            .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "customer_id",
                    "txn_count", "amount"))


def dedup(txn: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop replayed transaction ids (state kept while within the watermark)."""
    return txn.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def structuring_state(txn: DataFrame, params: Params = DEFAULT_PARAMS, delay: str = "1 day") -> DataFrame:
    """Keyed state per customer: an alert when the just-under rows of ``(t - w, t]`` reach the minimum.

    An event is judged once, when the watermark has passed it: all rows up to its time are then known, so the alerts
    do not depend on how the rows are spread over micro-batches. An alert is emitted for an event whose window holds
    at least ``min_count`` just-under rows, unless an alert was already emitted inside that window. State holds the
    rows after the watermark (they wait) and those up to one window before it, in bounded values by time slot
    (``keyed.StructuringProcessor``); timers remove it when neither is left. State variables of this kind need the
    RocksDB state store: start the query with ``run_available_now(..., rocksdb=True)`` or set the provider of the session.
    """
    p = params
    ju = (txn.filter((F.col("amount") >= p.structuring_lower_bound) & (F.col("amount") < p.structuring_threshold))
          .select("customer_id", "timestamp", "transaction_id")
          .withWatermark("timestamp", delay))
    return ju.groupBy("customer_id").transformWithStateInPandas(
        statefulProcessor=StructuringProcessor(p), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append", state_partitions: int | None = None, rocksdb: bool = False) -> None:
    """Process everything available, exactly once into a file sink, then stop.

    ``state_partitions``: shuffle / state-store partitions of a new query (a
    stream keeps the count of its first start in its checkpoint); ``rocksdb``:
    the state store that keyed state variables need. The session settings are
    restored afterwards.
    """
    spark = df.sparkSession
    wanted = {"spark.sql.shuffle.partitions": str(state_partitions) if state_partitions else None,
              "spark.sql.streaming.stateStore.providerClass": ROCKSDB if rocksdb else None}
    previous = {k: spark.conf.get(k) for k, v in wanted.items() if v is not None}
    for k in previous:
        spark.conf.set(k, wanted[k])
    try:
        q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out_path))
        q.awaitTermination()
    finally:
        for k, v in previous.items():
            spark.conf.set(k, v)
    if q.exception():
        raise q.exception()


def deliver(chunks: list[DataFrame], folder: str, run: Callable[[], None]) -> None:
    """Appends each chunk of rows (any number of files) to a stream's folder and processes it before the next."""
    for chunk in chunks:
        chunk.write.mode("append").parquet(folder)
        run()


def route_late_rows(stream: DataFrame, ts_col: str, delay_us: int, out_dir: str, checkpoint: str) -> None:
    """Split each micro-batch into on-time and late rows (older than the watermark) and store both.

    The watermark of batch k is the largest event time of batches before k minus the delay, as in Spark's own operators.
    Each batch is written to its own ``rows/batch=<id>`` folder with overwrite. What the write observes, its rows, its late
    rows and the largest time of all batches so far, goes to ``batches/batch=<id>``: one row, and the only one that the next
    batch reads. A batch that is replayed after a crash reads its predecessor's row again and is judged as before.
    """
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, latest = batch.sparkSession, None
        if batch_id > 0:
            latest = spark.read.schema("t long").parquet(f"{out_dir}/batches/batch={batch_id - 1}").first()[0]
        late = F.lit(False) if latest is None else us < F.lit(latest - delay_us)
        seen = Observation()
        (batch.withColumn("late", F.coalesce(late, F.lit(False)))
         .observe(seen, F.count(F.lit(1)).alias("input_rows"), F.count_if("late").alias("late_rows"), F.max(us).alias("t"))
         .write.mode("overwrite").parquet(f"{out_dir}/rows/batch={batch_id}"))
        got = seen.get
        times = [t for t in (latest, got["t"]) if t is not None]
        (spark.createDataFrame([(max(times, default=None), got["input_rows"], got["late_rows"])], "t long, input_rows long, late_rows long")
         .coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/batches/batch={batch_id}"))

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def late_batches(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch, input_rows, late_rows) of every batch that ``route_late_rows`` has written to ``out_dir``."""
    return spark.read.schema("input_rows long, late_rows long, batch long").parquet(f"{out_dir}/batches").select("batch", "input_rows", "late_rows")
