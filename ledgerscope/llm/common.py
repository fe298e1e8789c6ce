"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    return cut_lineage(df, compression)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_col: str, text_col: str) -> Column:
    """128-bit key of (id, text); null id and null text have marks of their own, so the key is never null."""
    return F.md5(F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit("\u0001"),
        F.when(F.col(text_col).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(text_col).cast("string")))))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z, as UTF-8 bytes.

    ``bytes.lower`` touches A-Z only and ``bytes.split`` splits on exactly 0x20 and 0x09-0x0D.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_MEMOS: list[dict] = []


def worker_memo() -> dict:
    """An empty memo of this worker process, which ``give_back`` may empty between two tasks."""
    _MEMOS.append({})
    return _MEMOS[-1]


def give_back(memos: bool = True) -> None:
    """At the end of a task: what the allocators hold free goes back to the system, and memos of other operators are emptied.

    Python workers live on from task to task and from operator to operator, and what they hold counts for the executor.
    ``memos=False`` is for tasks of the operator whose memo serves the next task.
    """
    if memos:
        for memo in _MEMOS:
            memo.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_with_columns(df: DataFrame, added: list[tuple[str, T.DataType]], fn) -> DataFrame:
    """All columns of ``df`` plus ``added``, computed by ``fn(iterator of batches)``.

    ``fn`` yields, per record batch, the list of arrays of the added columns. A column of ``df`` that already
    has an added name is replaced. Runs as one narrow ``mapInArrow`` pass.
    """
    names = {n for n, _ in added}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    schema = T.StructType(list(kept.schema.fields) + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield b

        held: list[pa.RecordBatch] = []
        for arrays in fn(keep()):
            b = held.pop(0)
            yield pa.RecordBatch.from_arrays(list(b.columns) + list(arrays), names=list(b.schema.names) + [n for n, _ in added])
        give_back()

    return kept.mapInArrow(run, schema)


def batch_texts(batch: pa.RecordBatch, column: str) -> Iterable[str | None]:
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(column)))
