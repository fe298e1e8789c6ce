"""Periodic runs of words by an online sparse diagonal recurrence.

A run is a longest stretch of words with smallest period q (words q apart are identical) and at least
``max(min_length, exponent * q)`` words. Diagonal d of a text compares word i with word i - d. The words are read
once, in order: the earlier occurrences of the word just read increment the match lengths of their diagonals
(``DiagonalTable``), and a diagonal that ends with a sufficient length emits its run at once.

Which earlier occurrences count is sparse, and nothing is lost by it. With ``exponent`` at least 4 a diagonal d in
[2^k, 2^(k+1)) must match 3 * 2^k words on end. So an occurrence counts only if the whole gram of 3 * 2^k words up
to the word stands there too, and of these only the nearest one, if its lag is in that range: within a run the gram
(longer than the period) stands exactly at the multiples of q, and the lags that are multiples describe the same
stretch with a period that is not its smallest. A word so has at most one occurrence for each power of two, whatever
its frequency; a text of one repeated word is linear. Grams are compared exactly, by ranks that double in length, and
a level without any repeated gram ends the search, since no longer gram repeats then.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerscope.llm.common import map_with_columns

#: Words whose ranks are made together (a longer text has its own group).
GROUP_WORDS = 400_000
RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def text_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8 bytes (``bytes.split`` splits on exactly those six characters)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class DiagonalTable:
    """Match lengths of the active diagonals of one text."""

    def __init__(self, min_length: int, exponent: int):
        self.min_length, self.exponent = min_length, exponent
        self.active: dict[int, list[int]] = {}  # lag -> [first matching word, words matched]
        self.runs: list[tuple[int, int, int]] = []

    def word(self, i: int, occurrences: Iterable[tuple[int, int]]) -> None:
        """Reads word ``i``: (lag, words matched on end up to and with i) of its earlier occurrences."""
        for lag, gram in occurrences:
            diagonal = self.active.get(lag)
            if diagonal is not None and diagonal[0] + diagonal[1] == i:
                diagonal[1] += 1
            else:
                if diagonal is not None:
                    self._end(lag, diagonal)
                self.active[lag] = [i - gram + 1, gram]

    def end_before(self, i: int) -> None:
        """Ends the diagonals that do not reach word ``i - 1``."""
        for lag in [d for d, (first, n) in self.active.items() if first + n < i]:
            self._end(lag, self.active.pop(lag))

    def _end(self, lag: int, diagonal: list[int]) -> None:
        first, matched = diagonal
        if matched + lag >= max(self.min_length, self.exponent * lag):
            self.runs.append((first - lag, matched + lag, lag))

    def finish(self) -> list[tuple[int, int, int]]:
        for lag, diagonal in self.active.items():
            self._end(lag, diagonal)
        self.active = {}
        return sorted(self.runs, key=lambda r: (r[0], r[2]))


def _ranks(values: np.ndarray) -> tuple[np.ndarray, bool]:
    """Dense ranks of the values, and whether any value repeats."""
    distinct, ranks = np.unique(values, return_inverse=True)
    return ranks.astype(np.int64), len(distinct) < len(values)


def occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, gram length) of the earlier occurrences that count, ordered by place.

    ``words`` are word numbers; the texts of a group are made different from each other before (no gram spans two).
    """
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    place = np.arange(len(words))
    # number[j] is the rank of the gram of ``width`` words that ends at place[j]; places whose gram is unique leave
    for k in itertools.count():
        width = 1 << k
        gram = 3 * width
        if k == 0:
            number, again = _ranks(words)
        else:
            # the gram of ``width`` words is that of half its width here and that of half its width before it
            half = width >> 1
            before = np.full(len(words), -1, np.int64)
            before[place] = number
            earlier = np.where(place >= half, before[place - half], -1)
            joined = earlier >= 0
            place = place[joined]
            number, again = _ranks(earlier[joined] * (len(words) + 1) + number[joined])
        if not again or not len(place):
            break
        counts = np.bincount(number)
        repeated = counts[number] > 1
        place, number = place[repeated], number[repeated]
        # three neighbouring grams of ``width`` words make the gram of this level
        at = np.full(len(words), -1, np.int64)
        at[place] = number
        whole = place >= 2 * width
        last = place[whole]
        one, two = at[last - width], at[last - 2 * width]
        whole = (one >= 0) & (two >= 0)
        last, one, two = last[whole], one[whole], two[whole]
        if not len(last):
            continue
        pair, _ = _ranks(two * (len(words) + 1) + one)
        triple, _ = _ranks(pair * (len(words) + 1) + at[last])
        order = np.argsort(triple, kind="stable")
        same = triple[order[1:]] == triple[order[:-1]]
        lag = last[order[1:]] - last[order[:-1]]
        ours = same & (lag >= width) & (lag < 2 * width)
        found.append((last[order[1:]][ours], lag[ours], gram))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    places = np.concatenate([f[0] for f in found])
    lags = np.concatenate([f[1] for f in found])
    grams = np.concatenate([np.full(len(f[0]), f[2], np.int64) for f in found])
    order = np.argsort(places, kind="stable")
    return places[order], lags[order], grams[order]


def runs_of_texts(texts: list[list[bytes]], min_length: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, given as its words, by start, then period."""
    if exponent < 4 or min_length < 1:
        raise ValueError("runs need an exponent of at least 4 and a length of at least 1")
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat += np.repeat(np.arange(len(texts)), sizes) * (len(numbers) + 1)
    places, lags, grams = occurrences(flat)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(first, places, "right") - 1
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
        if a == b:
            continue
        text = int(owner[a])
        table, base = DiagonalTable(min_length, exponent), int(first[text])
        for i, seen in itertools.groupby(zip((places[a:b] - base).tolist(), lags[a:b].tolist(), grams[a:b].tolist()), key=lambda s: s[0]):
            table.end_before(i)
            table.word(i, [(lag, gram) for _, lag, gram in seen])
        out[text] = table.finish()
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped).tolist()) if d == 0]


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, exponent: int = 4,
              names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """All columns of ``docs`` plus all runs of the text (array of start, length, period) and the text without repeats.

    Runs are ordered by start, then period; starts and lengths count words from 0. ``collapsed`` joins by one space the
    words that no run contains after its first ``period`` words. Null, empty and blank texts have no runs and an empty
    collapsed text; repeated rows are judged once each; a column that has an added name is replaced; an empty table
    gives an empty one. One narrow pass: a task holds one record batch and the ranks of one group of texts.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            runs, collapsed, held, n = [], [], [], 0

            def flush():
                for words, found in zip(held, runs_of_texts(held, min_length, exponent)):
                    runs.append([{"start": s, "length": x, "period": p} for s, x, p in found])
                    collapsed.append(b" ".join(kept_words(words, found)))

            for text in batch.column(batch.schema.get_field_index(text_col)):
                words = text_words(text.as_py())
                if held and n + len(words) > GROUP_WORDS:
                    flush()
                    held, n = [], 0
                held.append(words)
                n += len(words)
            if held:
                flush()
            yield [pa.array(runs, _RUN), pa.array(collapsed, pa.binary()).cast(pa.string())]

    return map_with_columns(docs, [(names[0], RUN), (names[1], T.StringType())], run)
