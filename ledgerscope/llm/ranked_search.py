"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Documents stay where they are read. A first narrow pass counts documents, terms and the documents of each query term.
In the second one every task indexes its documents in blocks: one list a term, sorted by falling impact, the share of a
document's score that depends on the document. For each item the lists of its terms are read from the top, in steps.
Every document met has a lower bound (the parts read) and an upper one (the lists that have not shown it may still add
what they show next). Reading goes on until no unmet document can reach the k-th best lower bound, then until every
document that still can has equal bounds, so that membership, ties and scores are final. What a task has found so far
bounds its next blocks. Tasks return their best k for each item, and two windows keep the best k of all.

Items come in blocks of bounded text, one at a time, and only one block's terms are held by the driver and the tasks.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import materialise

#: Bytes of item texts in a block of items, postings in a block of a task's index, words looked up at once.
ITEM_BYTES, POSTINGS, GROUP_WORDS = 4_000_000, 3_000_000, 300_000
# Fixed values of the score: length share in percent, scales of weight and of impact.
LENGTH_SHARE, WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE = 75, 1000, 1_000_000_000, 1000, 8
#: Bytes outside terms become spaces, A-Z lower case; bytes of other characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_COUNTS = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("n", T.LongType())])
_FOUND = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
DOCUMENTS, LENGTHS = -1, -2


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text: longest stretches of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Best:
    """The best k (score, id) of one item so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def bar(self) -> int:
        """The least score that can still enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


class ImpactIndex:
    """Impact-sorted lists of a block of documents."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, ids: np.ndarray, null: np.ndarray,
                 terms: int, documents: int, lengths: int):
        if LENGTH_SHARE * int(length.max(initial=0)) * documents >= 2 ** 63:
            share = np.array([LENGTH_SHARE * int(n) * documents // lengths for n in length], np.int64)
        else:
            share = LENGTH_SHARE * length * documents // max(lengths, 1)
        m = 100 - LENGTH_SHARE + share
        tf = tf.astype(np.int64)
        impact = IMPACT_SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        self.ids, self.null = ids, null
        self.low = np.zeros(len(ids), np.int64)
        self.slot = np.full(len(ids), -1, np.int64)

    def search(self, query: list[tuple[int, int]], best: Best, step: int = 64) -> None:
        """Adds to ``best`` what this block holds of the item's best k; ``query``: (term, weight) without repeats."""
        lists = [(self.doc[a:b], self.impact[a:b], w) for t, w in query if w > 0 for a, b in [(self.first[t], self.first[t + 1])] if a < b]
        front = np.array([int(v[0]) * w for _, v, w in lists], np.int64)  # what an unread place of each list adds at most
        read = [0] * len(lists)
        if not lists or front.sum() < best.bar:
            return
        low, met, bar = self.low, [], best.bar

        def advance(i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
            docs, values, w = lists[i]
            a, b = read[i], min(read[i] + n, len(docs))
            read[i], front[i] = b, int(values[b]) * w if b < len(docs) else 0
            return docs[a:b], values[a:b] * w

        # 1: read all lists in steps until a document that has not been met cannot enter
        while front.any():
            for i in range(len(lists)):
                if front[i]:
                    docs, parts = advance(i, step)
                    low[docs] += parts
                    met.append(docs)
            step *= 2
            known = low[low > 0]
            if len(known) >= best.k:
                bar = max(best.bar, int(np.partition(known, -best.k)[-best.k]))
            if front.sum() < bar:
                break
        # 2: the documents met that may enter; the parts not read yet are wanted for these only
        some = np.flatnonzero(low)
        some = some[low[some] + front.sum() >= bar]
        score = low[some]
        for docs in met:
            low[docs] = 0
        self.slot[some] = np.arange(len(some))
        shown = np.zeros((len(lists), len(some)), bool)
        for i, (docs, _, _) in enumerate(lists):
            at = self.slot[docs[:read[i]]]
            shown[i, at[at >= 0]] = True
        while True:
            high = score + front @ ~shown
            if len(score) >= best.k:
                bar = max(bar, int(np.partition(score, -best.k)[-best.k]))
            in_reach = high >= bar
            if not in_reach.all():
                self.slot[some] = -1
                some, score, shown, high = some[in_reach], score[in_reach], shown[:, in_reach], high[in_reach]
                self.slot[some] = np.arange(len(some))
            if np.array_equal(high, score):
                break
            open_lists = np.flatnonzero((front > 0) & ~shown.all(axis=1))
            for i in open_lists.tolist():
                docs, parts = advance(i, step)
                at = self.slot[docs]
                ours = at >= 0
                score[at[ours]] += parts[ours]
                shown[i, at[ours]] = True
            step *= 2
        self.slot[some] = -1
        best.add(score, self.ids[some], self.null[some])


def _postings(batches: Iterable[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[tuple]:
    """Per group of texts: ids, null flags, terms of each text (with repeats), and postings (text of the group, term, tf)."""
    get, none, terms = number.get, itertools.repeat(-1), len(number)

    def group(ids, texts):
        lengths = np.array([len(x) for x in texts], np.int64)
        found = np.fromiter(map(get, itertools.chain.from_iterable(texts), none), np.int64, int(lengths.sum()))
        key = np.repeat(np.arange(len(texts)), lengths) * terms + found
        key, tf = np.unique(key[found >= 0], return_counts=True)
        null = np.array([i is None for i in ids], bool)
        return np.array([0 if i is None else i for i in ids], np.int64), null, lengths, key // max(terms, 1), key % max(terms, 1), tf

    for batch in batches:
        ids, texts, words = [], [], 0
        for i, text in zip(batch.column(0), batch.column(1)):
            ids.append(i.as_py())
            texts.append(terms_of(text.as_py()))
            words += len(texts[-1])
            if words >= GROUP_WORDS:
                yield group(ids, texts)
                ids, texts, words = [], [], 0
        if ids:
            yield group(ids, texts)


def _term_counts(docs: DataFrame, number: dict[bytes, int]) -> dict[int, int]:
    """Documents of each numbered term, all documents with a term, and all their terms: at most one row a term."""
    def run(batches):
        counts, documents, lengths = np.zeros(len(number), np.int64), 0, 0
        for _, _, length, _, term, _ in _postings(batches, number):
            counts += np.bincount(term, minlength=len(number))
            documents += int((length > 0).sum())
            lengths += int(length.sum())
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), DOCUMENTS, LENGTHS], pa.int32()),
                                          pa.array([*counts[seen].tolist(), documents, lengths], pa.int64())], names=["term", "n"])

    summed = docs.mapInArrow(run, _COUNTS).groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in summed.collect()}


def _search_block(docs: DataFrame, items: list[Row], k: int) -> DataFrame | None:
    """(item, doc_id, score): each task's best ``k`` for every item of the block; None if no item has a term."""
    wanted = [(r["_item"], Counter(terms_of(r["_text"]))) for r in items]
    number: dict[bytes, int] = {}
    for _, terms in wanted:
        for t in terms:
            number.setdefault(t, len(number))
    if not number:
        return None
    counts = _term_counts(docs, number)
    documents, lengths = counts.pop(DOCUMENTS, 0), counts.pop(LENGTHS, 0)
    weight = {t: math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in counts.items()}
    queries = [(i, [(number[t], weight[number[t]] * n) for t, n in terms.items() if number[t] in weight]) for i, terms in wanted]

    def run(batches):
        best = {i: Best(k) for i, _ in queries}

        def flush(held):
            sizes = [len(h[0]) for h in held]
            shift = np.concatenate([[0], np.cumsum(sizes)])
            index = ImpactIndex(
                np.concatenate([h[4] for h in held]), np.concatenate([h[3] + s for h, s in zip(held, shift.tolist())]),
                np.concatenate([h[5] for h in held]), np.concatenate([h[2] for h in held]), np.concatenate([h[0] for h in held]),
                np.concatenate([h[1] for h in held]), len(number), documents, lengths)
            for i, query in queries:
                index.search(query, best[i])

        held, size = [], 0
        for part in _postings(batches, number):
            if size and size + len(part[3]) > POSTINGS:
                flush(held)
                held, size = [], 0
            held.append(part)
            size += len(part[3]) + len(part[0])
        if held:
            flush(held)
        for i, b in best.items():
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(b.score), pa.int64()), pa.array(b.id, pa.int64(), mask=b.null),
                                                  pa.array(b.score, pa.int64())], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score for each item, all of them if fewer score above 0.

    Every row of ``docs`` is a document and every row of ``items`` an item: repeated rows have results of their own.
    Equal scores rank by ascending document id, null ids last. Documents and items without a term (null, empty, blank) have
    no result; empty tables give an empty one; other columns are not read. An action: each block of items is searched and
    written before the next one is read.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    asked = items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("_text"))
    size = asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    spread = asked.repartition(-(-size // ITEM_BYTES) or 1)
    w = Window.partitionBy("_part").orderBy("_item").rowsBetween(Window.unboundedPreceding, -1)
    asked = materialise(spread.select("*", F.monotonically_increasing_id().alias("_item"), F.spark_partition_id().alias("_part")))
    before = F.coalesce(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(w), F.lit(0))
    asked = materialise(asked.withColumn("_block", F.floor(before / ITEM_BYTES)))
    found = []
    for r in asked.select("_part", "_block").distinct().orderBy("_part", "_block").collect():
        block = asked.where((F.col("_part") == r["_part"]) & (F.col("_block") == r["_block"])).select("_item", "_text").collect()
        result = _search_block(texts, block, k)
        if result is not None:
            found.append(materialise(result))
    if not found:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = functools.reduce(DataFrame.unionByName, found).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = some.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("_r") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return (ranked.join(asked.select(F.col("_item").alias("item"), "item_id"), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
