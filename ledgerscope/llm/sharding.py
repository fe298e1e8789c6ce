"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` equal cells; each shard owns ``virtual`` points on it, and a cell belongs to the shard of the
next point clockwise. A row falls into the cell of its key's hash. Cells arrive in the order of a second hash; a
cell's rows go to its shard while that has room, and what does not fit continues clockwise to the next shard with
room. The bound of a shard is ceil((1 + epsilon) * rows / shards); with epsilon 0 the bounds are floor and ceil of
the mean and add up to all rows, so that the counts are at most one apart.

The walk needs only the number of rows of each cell (``cells`` rows, a parameter). Rows are never gathered by shard:
they are sorted by cell with range partitions, a row's place within its cell is its global position less the
cell's first one, and the walk's result says which places of a cell go to which shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import materialise

CELLS = 1 << 14
VIRTUAL = 64


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def ring_of(shards: int, virtual: int = VIRTUAL, cells: int = CELLS) -> list[list[int]]:
    """For each cell, the shards in the order in which a row going clockwise meets them."""
    points = sorted((_hash("point", s, v) % cells, _hash("tie", s, v), s) for s in range(shards) for v in range(virtual))
    order: list[list[int]] = [[] for _ in range(cells)]
    k = len(points)
    following: list[list[int]] = [[]] * k
    last = [k * 3] * shards  # position at which each shard is met next, going backwards over two turns
    for i in range(2 * k - 1, -1, -1):
        last[points[i % k][2]] = i
        if i < k:
            following[i] = sorted(range(shards), key=last.__getitem__)
    at = 0
    for cell in range(cells):
        while at < k and points[at][0] < cell:
            at += 1
        order[cell] = following[at % k]
    return order


def assign_cells(counts: dict[int, int], shards: int, epsilon: float = 0.0, virtual: int = VIRTUAL,
                 cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, first place, end place, shard, first slot) that hold every row of every cell once."""
    n = sum(counts.values())
    if epsilon:
        bounds = [-(-int((1 + epsilon) * n + 0.5) // shards)] * shards
    else:
        bounds = [n // shards + (s < n % shards) for s in range(shards)]
    ring, loads, pieces = ring_of(shards, virtual, cells), [0] * shards, []
    for cell in sorted(counts, key=lambda c: (_hash("arrival", c), c)):
        place, rest = 0, counts[cell]
        for shard in ring[cell]:
            take = min(rest, bounds[shard] - loads[shard])
            if take > 0:
                pieces.append((cell, place, place + take, shard, loads[shard]))
                loads[shard] += take
                place, rest = place + take, rest - take
            if not rest:
                break
    return pieces


def shard_rows(docs: DataFrame, shards: int = 16, epsilon: float = 0.0, id_col: str = "doc_id", text_col: str = "text",
               virtual: int = VIRTUAL, cells: int = CELLS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (bytes of the text plus 1), text_crc32, cell, shard, slot.

    ``slot`` counts from 0 in each shard without gaps. Null texts have no bytes and the checksum of the empty text;
    null ids share one cell; repeated rows each get a slot (a hot key overflows clockwise like any other rows).
    Other columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(key.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    rows = (rows.withColumn("h", F.xxhash64("doc_id")).withColumn("cell", F.pmod("h", F.lit(cells)).cast("int"))
            # equal rows are interchangeable; a number of their own lets range partitions split any number of them
            .withColumn("salt", F.monotonically_increasing_id()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "h", "doc_id", "text_crc32", "size", "salt"]
    placed = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .select("doc_id", "size", "text_crc32", "cell", F.spark_partition_id().alias("part"),
                                 F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
    parts = placed.groupBy("part").agg((F.max("row") + 1).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).limit(cells).collect()}
    first, total = {}, 0
    for cell in sorted(counts):
        first[cell], total = total, total + counts[cell]
    pieces = [(c, first[c] + a, first[c] + b, s, slot) for c, a, b, s, slot in assign_cells(counts, shards, epsilon, virtual, cells)]
    assert len(pieces) <= cells + shards * (shards + 1), "a shard fills once, so pieces are bounded by cells and shards"
    plan = spark.createDataFrame(pieces, "cell int, from_place long, to_place long, shard int, first_slot long")
    place = F.col("before") + F.col("row")
    return (placed.join(F.broadcast(parts), "part").join(F.broadcast(plan), "cell")
            .where((place >= F.col("from_place")) & (place < F.col("to_place")))
            .select("doc_id", "size", "text_crc32", "cell", "shard", (F.col("first_slot") + place - F.col("from_place")).alias("slot")))
