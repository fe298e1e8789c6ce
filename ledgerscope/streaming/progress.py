"""Figures of each micro-batch, taken from the streaming engine while a query runs."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

BATCHES = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("input_rows", T.LongType()),
    T.StructField("watermark", T.StringType()), T.StructField("state_rows", T.LongType()), T.StructField("dropped_rows", T.LongType()),
    T.StructField("observed", T.MapType(T.StringType(), T.LongType()))])


class BatchLog(StreamingQueryListener):
    """Listener that keeps one row a micro-batch of the queries it hears, the latest ``keep`` of them.

    ``dropped_rows`` are the rows that stateful operators dropped as older than the watermark, ``observed`` the whole-number
    metrics of ``DataFrame.observe`` as ``name.metric``. ``hear`` limits the log to queries started inside it.
    """

    def __init__(self, keep: int = 10_000):
        self.keep, self.rows, self._runs, self._ended = keep, [], set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._ended:
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {f"{name}.{metric}": int(value) for name, row in (p.observedMetrics or {}).items()
                    for metric, value in row.asDict().items() if isinstance(value, int)}
        state = p.stateOperators or []
        self.rows.append((str(p.runId), p.batchId, p.numInputRows, (p.eventTime or {}).get("watermark"),
                          sum(s.numRowsTotal for s in state), sum(s.numRowsDroppedByWatermark for s in state), observed))
        del self.rows[:-self.keep]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._runs.discard(str(event.runId))
            self._ended.notify_all()

    def settle(self, seconds: float = 60.0) -> None:
        """Waits until the end of every query started so far has been heard (events come after the query's own end)."""
        with self._ended:
            if not self._ended.wait_for(lambda: not self._runs, seconds):
                raise TimeoutError("a streaming query has not ended")

    def table(self, spark: SparkSession) -> DataFrame:
        """The log as a table, one row a micro-batch that had a progress report."""
        return spark.createDataFrame(self.rows, BATCHES)


@contextlib.contextmanager
def hear(spark: SparkSession, keep: int = 10_000) -> Iterator[BatchLog]:
    """A log of the queries that run inside the block; complete when the block ends."""
    log = BatchLog(keep)
    spark.streams.addListener(log)
    try:
        yield log
        log.settle()
    finally:
        spark.streams.removeListener(log)
