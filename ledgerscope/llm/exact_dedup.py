"""Exact dedup by a content sort.

Rows are dealt by sampled range splitters over (first bytes, hash, id) of the normalised text and sorted within
each partition by (first bytes, hash, whole text, id), so equal texts are adjacent. The splitter key is short, so
that the sample which the driver holds stays small however long the texts are, and its id part lets a group of
copies of any size spread over several partitions. Neighbours are then compared over their whole bytes, in one
streaming pass that keeps a single text in memory. A group which crosses a partition border is joined again by
comparing the border texts of neighbouring partitions, which is exact too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import ascii_lower, materialise, text_or_empty

#: Characters of the text in the splitter key; only the order of the sort depends on it, no result does.
SPLITTER_CHARS = 16

_RUNS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("run", T.LongType()), T.StructField("border", T.StringType()), T.StructField("text", T.BinaryType()),
])


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbours; the first and the last row of a partition carry their text."""
    part, run, last, digest = TaskContext.get().partitionId(), -1, None, ""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.string()), ("part", pa.int32()), ("run", pa.int64()),
                        ("border", pa.string()), ("text", pa.binary())])

    def out(ids, digests, runs, border=None, texts=None):
        n = len(ids)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array([part] * n, pa.int32()),
            pa.array(runs, pa.int64()), pa.array([border] * n, pa.string()), pa.array(texts or [None] * n, pa.binary())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, digests, runs = batch.column(0).to_pylist(), [], []
        texts = batch.column(1)
        for x in texts:
            text = x.as_py()
            if text != last:
                run, last, digest = run + 1, text, hashlib.sha256(text).hexdigest()
                if run == 0:
                    yield out([None], [digest], [run], "first", [text])
            digests.append(digest)
            runs.append(run)
        yield out(ids, digests, runs)
    if last is not None:
        yield out([None], [digest], [run], "last", [last])


def _groups_over_borders(borders: DataFrame) -> DataFrame:
    """(part, run) -> (first part, first run) of the group, for runs that continue from an earlier partition.

    Each non-empty partition has one first and one last row. Neighbouring partitions meet in a join, where the two
    texts are compared; the window then sees one small row a partition.
    """
    one = borders.groupBy("part").agg(
        F.max(F.when(F.col("border") == "last", F.col("run"))).alias("last_run"),
        F.max(F.when(F.col("border") == "first", F.col("text"))).alias("first_text"),
        F.max(F.when(F.col("border") == "last", F.col("text"))).alias("last_text"))
    # partitions without rows have no borders: neighbours are consecutive among those that have some
    order = Window.orderBy("part")
    rank = one.select("part", "last_run").withColumn("rank", F.row_number().over(order))
    ranked = one.join(rank.select("part", "rank"), "part")
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("last_text").alias("before"))
    joined = (ranked.join(before, "rank", "left")
              .select("rank", "part", "last_run", F.coalesce(F.col("before") == F.col("first_text"), F.lit(False)).alias("goes_on")))
    # A group goes on through partition p if p's first run equals the last text before it; it passes p whole when
    # that run is p's only one. The start of the group is the last run of the nearest partition before that
    # either has other runs or does not go on.
    starts = (joined.withColumn("start", F.when(~F.col("goes_on") | (F.col("last_run") > 0), F.struct("part", F.col("last_run").alias("run"))))
              .withColumn("start", F.last("start", ignorenulls=True).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))))
    return (starts.where("goes_on").select("part", F.lit(0).cast("long").alias("run"),
                                            F.col("start.part").alias("to_part"), F.col("start.run").alias("to_run")))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                normalise: Column | None = None, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are (``normalise``: lower-casing A-Z unless given). Of equal texts
    the row with the smallest (``keep='largest'``: largest) id stays. Null texts count as empty. Null ids sort
    after all others, so they stay only where a group has no other id. Of several rows with the same id and equal
    texts all carry ``kept`` true, since an id is what stays. Other columns are not read; an empty table gives none.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = ascii_lower(text_or_empty(f"`{text_col}`")) if normalise is None else normalise
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("norm"))
    rows = rows.select("id", F.substring("norm", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("norm").alias("hash"),
                       F.encode("norm", "UTF-8").alias("norm"))
    by_id = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("head"), F.col("hash"), by_id).sortWithinPartitions("head", "hash", "norm", by_id)
    marked = materialise(dealt.select("id", "norm").mapInArrow(_mark_runs, _RUNS))
    over = _groups_over_borders(marked.where("border is not null").select("part", "run", "border", "text"))
    members = marked.where("border is null").select("id", "digest", "part", "run")
    best = F.min("id") if keep == "smallest" else F.max("id")
    runs = members.groupBy("part", "run").agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
    runs = (runs.join(over, ["part", "run"], "left")
            .withColumn("to_part", F.coalesce("to_part", "part")).withColumn("to_run", F.coalesce("to_run", "run")))
    groups = runs.groupBy("to_part", "to_run").agg(
        F.sum("size").alias("group_size"), (F.min("best") if keep == "smallest" else F.max("best")).alias("keep_id"))
    of_run = runs.select("part", "run", "to_part", "to_run").join(groups, ["to_part", "to_run"])
    return (members.join(of_run, ["part", "run"])
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("digest").alias("text_sha256")))
