"""SimHash near-dedup with a segment-popcount embedding.

Fingerprint: every 3-word shingle (repeats included) is hashed with XXH64, and a bit is set where more than half
of the hashes have it set.

Search: the 64 bits are cut into 32 segments of two bits, and a fingerprint is embedded as its 32 bit counts
(0, 1 or 2). The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. The
counts are held in unary (0 = 00, 1 = 01, 2 = 11), so that the Manhattan distance is one XOR and one bit count.

Grid join: the segments form ``groups`` groups of coordinates. Two points within Manhattan distance d differ in at
most d coordinates, so they agree on at least ``groups - d`` whole groups: each choice of that many groups is one
grid, a point's coordinates in it are its cell, and every linked pair shares a cell of some grid. Points of one
cell are compared by the Manhattan bound, then exactly. Only distinct fingerprints take part, so exact copies of
any number are one point.

Crowded cells: a cell's points are cut into blocks of ``block`` points, and each pair of blocks is a task unit of
its own. Within a unit the links are searched as a spanning forest: a point leaves the unreached set once, and
only forest links are written (fewer than the points), never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import give_back, materialise, row_key, text_or_empty, words_of
from ledgerscope.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: Groups of coordinates. A grid fixes ``groups - MAX_DISTANCE`` of them: C(6, 3) = 20 cells a fingerprint, of about
#: 2 ** 24 occupied values each. For more than some 10 ** 9 distinct fingerprints take 8 (56 cells, 2 ** 30 values).
GROUPS = 6
BLOCK = 4096
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text (0 without words)."""
    import xxhash

    words = words_of(text)
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest, total, set_bits = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    while part := list(itertools.islice(shingles, 100_000) if not isinstance(shingles, list) else shingles):
        shingles = iter(()) if isinstance(shingles, list) else shingles
        hashes = np.array([digest(s, 42) for s in part], np.uint64)
        total += len(hashes)
        set_bits += np.add.reduce(np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.int64)
    # byte order of the hashes in memory is kept by packing the majority bits back the same way
    return int(np.packbits(2 * set_bits > total).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, key): one row per row, the fingerprint as a signed long, and a key of (id, text)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(x.as_py(), size) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "key"])
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"),
                       row_key(f"`{id_col}`", f"`{text_col}`").alias("key")).mapInArrow(run, schema)


def embed(fp: Column) -> Column:
    """The 32 segment counts in unary, as one long."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grids(groups: int = GROUPS, distance: int = MAX_DISTANCE) -> list[int]:
    """A mask of the embedding for each choice of ``groups - distance`` groups of coordinates."""
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    of_group = [sum(3 << 2 * s for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    return [sum(of_group[g] for g in chosen) for chosen in itertools.combinations(range(groups), groups - distance)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest_links(points: np.ndarray, embedded: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of a spanning forest of the points within ``distance`` bits of each other."""
    left, tos = [], []
    unreached = np.arange(len(points))
    frontier: list[int] = []
    while len(unreached):
        if frontier:
            p = frontier.pop()
        else:
            p, unreached = int(unreached[0]), unreached[1:]
        near = _popcount(embedded[unreached] ^ embedded[p]) <= distance  # Manhattan bound
        close = unreached[near]
        close = close[_popcount(points[close] ^ points[p]) <= distance]  # exact
        if len(close):
            left.append(np.full(len(close), p))
            tos.append(close)
            frontier.extend(close.tolist())
            unreached = np.setdiff1d(unreached, close, assume_unique=True)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(tos)


def _links_of_sorted(distance: int):
    """Links within runs of equal (grid, cell, unit) of a partition sorted by them."""

    def links(fps: np.ndarray, embedded: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts
        a, b = [], []
        for size in (2, 3, 4):  # small cells at once
            at = starts[sizes == size]
            for i, j in itertools.combinations(range(size), 2):
                x, y = at + i, at + j
                ok = _popcount(embedded[x] ^ embedded[y]) <= distance
                x, y = x[ok], y[ok]
                ok = _popcount(fps[x] ^ fps[y]) <= distance
                a.append(fps[x[ok]])
                b.append(fps[y[ok]])
        for s, e in zip(starts[sizes > 4].tolist(), ends[sizes > 4].tolist()):
            x, y = forest_links(fps[s:e], embedded[s:e], distance)
            a.append(fps[s:e][x])
            b.append(fps[s:e][y])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            grid, cell, unit, fps, embedded = held
            new = np.flatnonzero((grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]) | (unit[1:] != unit[:-1])) + 1
            if not len(new):
                continue  # one unit so far, of 2 * block points at most
            starts = np.concatenate([[0], new[:-1]])
            yield links(fps.view(np.uint64), embedded.view(np.uint64), starts, new)
            held = [x[new[-1]:] for x in held]
        if held is not None and len(held[0]):
            yield links(held[3].view(np.uint64), held[4].view(np.uint64), np.array([0]), np.array([len(held[0])]))

    return run


def near_links(points: DataFrame, distance: int = MAX_DISTANCE, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``points(fp)`` that join all pairs within ``distance`` bits.

    The links are forest links of each grid cell, so their transitive closure is that of all such pairs.
    """
    masks = grids(groups, distance)
    cells = (points.select("fp", embed(F.col("fp")).alias("e"))
             .select("fp", "e", F.explode(F.array(*[
                 F.struct(F.lit(i).alias("grid"), F.col("e").bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(masks)])).alias("g"))
             .select("g.grid", "g.cell", "fp", "e"))
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    shared = (cells.join(sizes, ["grid", "cell"]).withColumn("blocks", blocks).withColumn("own", own)
              .select("grid", "cell", "fp", "e", F.explode(F.transform(
                  F.sequence(F.lit(0), F.col("blocks") - 1),
                  lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")))).alias("unit")))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.repartition(n, "grid", "cell", "unit").sortWithinPartitions("grid", "cell", "unit", "fp")
    return dealt.select("grid", "cell", "unit", "fp", "e").mapInArrow(
        _links_of_sorted(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                    distance: int = MAX_DISTANCE, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), fingerprint (16 hex digits), component_id, key.

    ``component_id`` is the smallest id reachable over links of at most ``distance`` differing bits. Null and empty
    texts have fingerprint zero, which links like any other. Null ids are kept in the result and only give way in
    the minimum (a component of null ids alone has a null component). Repeated rows give repeated rows. Other
    columns are not read. An empty table gives none.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, size))
    points = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    classes = connected_components(near_links(points.select("fp"), distance, groups, block))
    named = points.join(classes.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_fp = materialise(named.select("fp", "component").join(lowest, "component"))
    return rows.join(of_fp, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", "key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                         distance: int = MAX_DISTANCE, groups: int = GROUPS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays.

    The row with the smallest id stays (null ids last; then the smallest key of id and text); of fully equal
    (id, text) rows one, whichever.
    """
    found = near_duplicates(docs, id_col, text_col, size, distance, groups)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("best"))
    keep = materialise(best.select(F.col("best.key").alias("_near_key")))
    marked = docs.withColumn("_near_key", row_key(f"`{id_col}`", f"`{text_col}`"))
    return marked.join(keep, "_near_key").dropDuplicates(["_near_key"]).drop("_near_key")
