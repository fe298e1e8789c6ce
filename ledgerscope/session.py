"""Session construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so timestamps compare across engines,
# AQE so shuffles are re-planned (coalesce, skew split, broadcast) at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Target shuffle partition size after AQE coalescing / skew splitting.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "ledgerscope",
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in conf.items():
        if not k.startswith("spark.ui") and not k.startswith("spark.driver"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must set it; it is read, never replaced, and an unset folder is an error there.
    Only a ``local`` master, where driver and executors are one process, gets a scratch folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share "
                         f"(it is unset, and the master is {master or 'unknown'})")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        spark.sparkContext.setCheckpointDir(
            tempfile.mkdtemp(prefix="ledgerscope-ckpt-", dir=os.environ.get("LEDGERSCOPE_SCRATCH", "/tmp")))
        own = spark.sparkContext.getCheckpointDir()
    return own


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed by ``clear_scratch`` or when the driver process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:16]}"
    if not _WRITTEN:
        atexit.register(clear_scratch, spark)
    _WRITTEN.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Removes every scratch path of this process (through Hadoop, so on any file system).

    Call it when no DataFrame made so far is needed any more.
    """
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return  # nothing can reach the shared folder any more; its own retention applies
    conf = context._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = context._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df, compression: str | None = None):
    """Materialise a table in the shared checkpoint folder and read it back (survives executor loss).

    Used for an intermediate table that several branches of one plan read:
    otherwise column pruning gives every branch its own, different copy of the
    upstream work and none of it is shared. This is an action: the table is
    written while the caller's plan is being built. ``compression``: a Parquet codec (the session's unless given).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    # A written table: computed once (checkpoint() would evaluate the plan twice
    # unless persisted), columnar, and readable after any executor is lost.
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
