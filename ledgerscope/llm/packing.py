"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as many pieces of ``max_length`` as fit,
then the binary digits of the rest in falling order. Every piece is a training sequence by itself, and sequences
of equal length form a bucket, so that a batch drawn from a bucket needs no padding and no sequence crosses two
documents.

The work is one narrow pass: no shuffle, memory bounded by one batch of texts. Sequence ids are numbered within
(bucket, input partition), so that a retried task gives the same ids and a bucket's ids are contiguous in sort
order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerscope.llm.common import give_back, text_or_empty
from ledgerscope.llm.subwords import SubwordEncoder

#: Bits of a sequence id: bucket (length = 2 ** bucket) | input partition | number within both.
PARTITION_BITS, NUMBER_BITS = 24, 32

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("bucket", T.IntegerType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def binary_lengths(n: int, max_length: int) -> list[int]:
    """Falling powers of two that sum to ``n``, none above ``max_length`` (itself a power of two)."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, max_length: int = 2048, end_id: int | None = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of every document; see ``PIECES`` for the columns.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers (null unless ``with_ids``).
    Null and empty texts have the end id alone (no piece at all when ``end_id`` is None); repeated rows are packed
    once each; null document ids stay null; other columns are not read.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SubwordEncoder.of(tokenizer)
        partition = TaskContext.get().partitionId()
        if partition >> PARTITION_BITS:
            raise ValueError("too many input partitions for a sequence id")
        numbers = [0] * max_length.bit_length()
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        schema = pa.schema([(f.name, t) for f, t in zip(PIECES, (
            pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))])

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, held = [], 0
            for doc_id, data in zip(doc_ids, encoder.encode_bytes(x.as_py() for x in texts)):
                data, start = data + end, 0
                n = len(data) // 4
                for length in binary_lengths(n, max_length):
                    bucket = length.bit_length() - 1
                    piece = data[4 * start:4 * (start + length)]
                    number = bucket << (PARTITION_BITS + NUMBER_BITS) | partition << NUMBER_BITS | numbers[bucket]
                    numbers[bucket] += 1
                    rows.append((doc_id, start, length, bucket, n, number, 0, zlib.crc32(piece),
                                 piece if with_ids else None))
                    start += length
                    held += len(piece) if with_ids else 64
                if held > 4_000_000:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)
        give_back(memos=False)

    narrow = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, PIECES)


def bucket_sizes(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens of each bucket (one row per power of two)."""
    from pyspark.sql import functions as F

    return pieces.groupBy("bucket").agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"))
