"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every training text is cut into overlapping passages, and every passage is a query to an index of the test items.
A score is BM25 divided by the item's score against itself, so 1 means that all the item's words are there. All
items at or above the threshold are retrieved, then verified: the 5-word shingles of the item's question and those
of its answer must both be in the passage to 0.8 or more. The answer is an item's last line, or its last sentence
if it has one line, or its last fifth of words if it has one sentence.

The index is the one thing that every task holds. It is built in blocks of at most ``block_words`` words of items,
each block searched by a pass over the texts; document frequencies are counted over all items first, so blocks do
not change a score.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import batch_texts, map_with_columns, materialise, text_or_empty

K1, B = 1.2, 0.75
THRESHOLD = 0.7
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 32
BLOCK_WORDS = 500_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_in(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    for parts in (text.strip().split("\n"), _SENTENCE.split(text.strip())):
        parts = [w for w in map(words_in, parts) if w]
        if len(parts) > 1:
            return [w for p in parts[:-1] for w in p], parts[-1]
    words = words_in(text)
    cut = len(words) - max(1, len(words) // 5)
    return words[:cut], words[cut:]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


@dataclass
class Index:
    """Inverted index: per word sorted item numbers and impacts, in blocks with their largest impact."""

    ids: list = field(default_factory=list)
    questions: list = field(default_factory=list)
    answers: list = field(default_factory=list)
    postings: dict = field(default_factory=dict)
    #: Word -> (item number, impact) of the items' heaviest words. An item's other words weigh half the threshold at
    #: most, so a passage that retrieves it has heavy words of at least ``needed`` weight.
    heavy: dict = field(default_factory=dict)
    needed: list = field(default_factory=list)
    longest: int = 0
    threshold: float = THRESHOLD


def build_index(items: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_length: float,
                threshold: float = THRESHOLD) -> Index:
    index, postings, heavy = Index(threshold=threshold), defaultdict(list), defaultdict(list)
    for item_id, text in items:
        words = words_in(text)
        if not words:
            continue
        number = len(index.ids)
        index.ids.append(item_id)
        question, answer = split_item(text)
        index.questions.append(question)
        index.answers.append(answer)
        index.longest = max(index.longest, len(words))
        norm = K1 * (1 - B + B * len(words) / mean_length)
        impact = {w: math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                  for w, tf in Counter(words).items()}
        whole = sum(impact.values())
        for w, x in impact.items():
            postings[w].append((number, x / whole))
        rest = 1.0  # weight of the words that are not counted as heavy
        for w, x in sorted(impact.items(), key=lambda p: (-p[1], -len(p[0]), p[0])):
            if rest <= threshold / 2:
                break
            heavy[w].append((number, x / whole))
            rest -= x / whole
        index.needed.append(threshold - rest - 1e-9)
    for w, pairs in postings.items():
        numbers, impacts = [p[0] for p in pairs], [p[1] for p in pairs]
        blocks = [(numbers[min(i + BLOCK, len(numbers)) - 1], max(impacts[i:i + BLOCK])) for i in range(0, len(numbers), BLOCK)]
        index.postings[w] = (numbers, impacts, [b[0] for b in blocks], [b[1] for b in blocks], max(impacts))
    index.heavy = dict(heavy)
    return index


def may_retrieve(index: Index, words: set[str]) -> bool:
    """Whether the heavy words of a passage reach what some item needs; without that no item reaches the threshold."""
    sums: dict[int, float] = {}
    for w in words:
        for number, x in index.heavy[w]:
            sums[number] = sums.get(number, 0.0) + x
    return any(x >= index.needed[number] for number, x in sums.items())


def search(index: Index, query: set[str]) -> list[tuple[int, float]]:
    """All (item number, score) at or above the threshold for a bag of words, by block-max WAND."""
    floor = index.threshold - 1e-9
    # a list: [current item, position, numbers, impacts, block ends, block maxima, maximum]
    lists = [[p[0][0], 0, *p] for w in query if (p := index.postings.get(w))]
    out, end = [], len(index.ids)
    while lists:
        lists.sort(key=lambda x: x[0])
        bound, pivot = 0.0, -1
        for i, x in enumerate(lists):
            bound += x[6]
            if bound >= floor:
                pivot = i
                break
        if pivot < 0:
            return out
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        shallow, until = 0.0, end
        for x in lists[:pivot + 1]:
            b = bisect_left(x[4], item)
            if b < len(x[4]):
                shallow += x[5][b]
                until = min(until, x[4][b] + 1)
        if shallow < floor:
            # no item up to the nearest end of these blocks, or the next list's item, can reach the threshold
            target = max(item + 1, min(until, lists[pivot + 1][0] if pivot + 1 < len(lists) else end))
        elif lists[0][0] == item:
            score = sum(x[3][x[1]] for x in lists[:pivot + 1])
            if score >= floor:
                out.append((item, score))
            target = item + 1
        else:
            target = item
        for x in lists[:pivot + 1]:
            if x[0] < target:
                x[1] = bisect_left(x[2], target, x[1])
                x[0] = x[2][x[1]] if x[1] < len(x[2]) else end
        lists = [x for x in lists if x[0] < end]
    return out


def _overlap(part: set, passage: set) -> float:
    return len(part & passage) / len(part) if part else 1.0


def leaks_in(index: Index, text: str | None, overlap: float = OVERLAP) -> list[tuple[int, int, int, float, float, float]]:
    """(item id, first word, end word, score, question overlap, answer overlap), the best passage of each item.

    A passage has twice as many words as the longest item and starts half its length after the one before, so an
    item's words in a row lie within one passage whole.
    """
    words = words_in(text)
    if not words or not index.ids:
        return []
    heavy, step = index.heavy, index.longest
    found: dict[int, set[str]] = defaultdict(set)  # heavy words of each passage
    for i, w in enumerate(words):
        if w in heavy:
            k = i // step
            found[k].add(w)
            if k:
                found[k - 1].add(w)
    best = {}
    for k in sorted(found):
        if not may_retrieve(index, found[k]):
            continue
        passage = words[k * step:(k + 2) * step]
        whole: dict[int, set] = {}  # the passage's shingles by length, made once

        def held(part: list[str]) -> float:
            if not part:
                return 1.0
            size = min(SHINGLE, len(part))
            if size not in whole:
                whole[size] = shingles(passage, size)
            return _overlap(shingles(part, size), whole[size])

        for number, score in search(index, set(passage)):
            q, a = held(index.questions[number]), held(index.answers[number])
            if q >= overlap and a >= overlap:
                row = (index.ids[number], k * step, k * step + len(passage), score, q, a)
                if number not in best or (row[4] + row[5], -row[1]) > (best[number][4] + best[number][5], -best[number][1]):
                    best[number] = row
    return [best[n] for n in sorted(best)]


def index_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD,
                 block_words: int = BLOCK_WORDS) -> Iterator[tuple[int, Index]]:
    """(number of blocks, index) of blocks that together hold every item, each of about ``block_words`` words (an item alone may have more).

    The driver holds one block at a time, if its caller lets go of it: its items, and the document frequencies of its words.
    """
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                n = Counter(words_in(x.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(n), pa.int64()), pa.array([x.as_py()] * len(n), pa.string()),
                                                  pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["id", "text", "word", "tf"])

    words = items.distinct().mapInArrow(count_words, "id long, text string, word string, tf long")
    totals = words.groupBy("id", "text").agg(F.sum("tf").alias("n")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    if not totals.items:
        return
    blocks = -(-totals.words // block_words)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for i in range(blocks):
        own = [(r.id, r.text) for r in items.distinct().where(block == i).orderBy("id", "text").toLocalIterator()]
        seen = words.where(block == i).select("word").distinct()
        df = {r.word: r.df for r in frequency.join(seen, "word", "left_semi").toLocalIterator()}
        index = build_index(own, df, totals.items, totals.words / totals.items, threshold)
        index.longest = totals.longest  # passages are the same for every block
        yield blocks, index


_LEAK = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
               overlap: float = OVERLAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``leaks``: an array with one struct for each verified item of the benchmark (a column of that name is replaced).

    Every row and column stays. Null and empty texts have no leaks; items without words leak nowhere; an empty
    benchmark gives empty arrays. Repeated rows are marked alike, repeated items count once. An item's best passage is the
    one of the largest overlaps, the first of equal ones.

    A benchmark of one block is searched in one narrow pass. A larger one is an action: block after block is searched and
    the leaks it finds are written by the digest of the text (few rows), then joined to ``docs``, so that driver and
    tasks never hold more than one block.
    """
    fields = [(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64()) for f in _LEAK.elementType]
    kind = pa.list_(pa.struct(fields))

    def searched(df: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
            for b in batches:
                yield [pa.array([[dict(zip((n for n, _ in fields), row)) for row in leaks_in(index, t, overlap)]
                                 for t in batch_texts(b, text_col)], kind)]
        return map_with_columns(df, [("leaks", _LEAK)], run)

    digest = F.md5(F.col(f"`{text_col}`").cast("string").cast("binary"))
    found = []
    for blocks, index in index_blocks(benchmark, threshold=threshold, block_words=block_words):
        if blocks == 1:
            return searched(docs, index)
        hits = searched(docs.select(F.col(f"`{text_col}`")), index).where(F.size("leaks") > 0)
        found.append(materialise(hits.groupBy(digest.alias("_leak_key")).agg(F.first("leaks").alias("_leaks")).withColumn("_block", F.lit(len(found)))))
    if not found:
        return docs.withColumn("leaks", F.array().cast(_LEAK))
    ordered = F.array_sort(F.collect_list(F.struct("_block", "_leaks")))
    leaks = functools.reduce(DataFrame.unionByName, found).groupBy("_leak_key").agg(F.flatten(F.transform(ordered, lambda x: x["_leaks"])).alias("leaks"))
    rows = docs.drop("leaks").withColumn("_text_key", digest)
    return (rows.join(leaks, F.col("_text_key") == F.col("_leak_key"), "left").drop("_text_key", "_leak_key")
            .withColumn("leaks", F.coalesce("leaks", F.array().cast(_LEAK))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any verified item, with their own columns only."""
    marked = mark_leaks(docs.withColumnRenamed("leaks", "_own_leaks") if "leaks" in docs.columns else docs, benchmark, text_col)
    out = marked.where(F.size("leaks") == 0).drop("leaks")
    return out.withColumnRenamed("_own_leaks", "leaks") if "_own_leaks" in out.columns else out
