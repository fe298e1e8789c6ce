"""Quality classifier by positive-unlabelled learning.

A small network is fitted to trusted positives and unlabelled web text by minimising the non-negative unbiased
risk: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)). The class prior pi is estimated from the same rows: with
a first classifier that tells positives from unlabelled text, the share of unlabelled text above a score is at
least pi times the share of positives above it, so the smallest ratio over high scores bounds pi from above.

Inputs of a score are measures of the whole text alone (``features_of``). They are taken once and written, a tenth of the
texts. Means, scales and the score histogram are Spark aggregates over all unlabelled rows, and the network is trained
on all of them: in each round every partition goes through its rows from the same weights, beside the positives, and the
weights are averaged by rows. Only the positives are a bounded sample (``MAX_POSITIVES`` labelled ids, the smallest by hash).
Scoring is one narrow pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import batch_texts, give_back, map_with_columns, materialise, text_or_empty, words_of

MAX_POSITIVES = 8000
#: Rounds of averaged training with their step sizes; steps of a partition in a round (more where its rows need more); rows a step.
RATES, FIRST_RATES = (0.02, 0.02, 0.02, 0.01, 0.01, 0.005), (0.02, 0.02)
STEPS, BATCH = 60, 1024
HIDDEN = 12
THRESHOLD = 0.3
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
N_FEATURES = 18 + len(_SYMBOLS)


def features_of(text: str | None) -> np.ndarray:
    """Measures of form, repetition and character mix of a whole text (zeros for a text without words)."""
    x = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(text)
    if not words:
        return x
    n, size = len(words), len(raw)
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words[1:], words))
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    letters = max(1, upper + lower)
    x[:18] = (
        math.log(size), math.log(n), size / n, math.log(len(counts)) / math.log(n + 1), len(counts) / n, same / n, top / n,
        pairs / n, math.log(pairs + 1) / math.log(n + 1), upper / letters, digits / size, hist[128:].sum() / size,
        len(set(lines)) / len(lines), math.log(len(lines)), n / len(lines), hist[10] / size, hist[32] / n, sum(c for c in counts.values() if c > 5) / n)
    x[18:] = np.log1p(100 * hist[_SYMBOLS] / n)
    return x


def _matrix(texts) -> np.ndarray:
    rows = [features_of(t) for t in texts]
    return np.array(rows) if rows else np.zeros((0, N_FEATURES))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return _sigmoid(_forward(self.weights, z)[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _forward(w: list[np.ndarray], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(z @ w[0] + w[1])
    return h, h @ w[2] + z @ w[3] + w[4][0]


def initial_weights(features: int, seed: int = 7) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.3 / math.sqrt(features), (features, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(features), np.zeros(1)]


def risk_gradients(w: list[np.ndarray], zp: np.ndarray, zu: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """(risk, what a step goes down along) for positives and unlabelled rows.

    With a prior: the non-negative unbiased risk of the log loss; where the estimated risk of negatives is below zero the step
    goes up that part instead. Without: the log loss of positives against unlabelled rows.
    """
    (hp, fp), (hu, fu) = _forward(w, zp), _forward(w, zu)
    sp, su = _sigmoid(fp), _sigmoid(fu)
    if prior is None:
        risk = np.mean(np.logaddexp(0, -fp)) + np.mean(np.logaddexp(0, fu))
        gp, gu = (sp - 1) / len(zp), su / len(zu)
    else:
        # log losses: R_p(+) = mean -log s, R(-) = mean -log(1 - s)
        negative = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
        risk = prior * np.mean(np.logaddexp(0, -fp)) + max(0.0, negative)
        if negative >= 0:
            gp, gu = prior * ((sp - 1) - sp) / len(zp), su / len(zu)
        else:
            gp, gu = prior * sp / len(zp), -su / len(zu)
    grads = [np.zeros_like(a) for a in w]
    for z, h, g in ((zp, hp, gp), (zu, hu, gu)):
        back = np.outer(g, w[2]) * (1 - h * h)
        for i, d in enumerate((z.T @ back, back.sum(0), h.T @ g, z.T @ g, np.array([g.sum()]))):
            grads[i] += d
    return float(risk), grads


def train(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None, rate: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Adam from ``w``, through every row of ``u`` once or for ``STEPS`` steps, whichever is more."""
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    size = min(len(u), BATCH)
    order = np.zeros(0, np.int64)
    for step in range(1, max(STEPS, -(-len(u) // BATCH)) + 1):
        if len(order) < size:
            order = np.concatenate([order, rng.permutation(len(u))])
        some, order = order[:size], order[size:]
        _, grads = risk_gradients(w, p[rng.integers(0, len(p), min(len(p), BATCH))].astype(float), u[some].astype(float), prior)
        for i, g in enumerate(grads):
            g = g + 1e-4 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w = [*w[:i], w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8), *w[i + 1:]]
    return w


def _flat(w: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in w])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, ends[:-1]), like)]


def _rows(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The measures of a partition as one matrix (200 bytes a document)."""
    parts = [b.column(b.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches if b.num_rows]
    return np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)


_SUMS = "place int, n long, a double, b double"


def _summed(measures: DataFrame, part: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, a, b) summed over the partitions: ``part`` gives a count and two vectors of ``size`` numbers for a partition's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _rows(batches)
        if len(x):
            n, a, b = part(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n, np.int64)), pa.array(np.asarray(a, float)),
                                              pa.array(np.asarray(b, float))], names=["place", "n", "a", "b"])

    got = measures.mapInArrow(run, _SUMS).groupBy("place").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("place").collect()
    if not got:
        return 0, np.zeros(size), np.zeros(size)
    return got[0]["n"], np.array([r["a"] for r in got]), np.array([r["b"] for r in got])


def averaged_training(measures: DataFrame, p: np.ndarray, w: list[np.ndarray], prior: float | None, rates: Sequence[float], mean: np.ndarray,
                      scale: np.ndarray, half: bool = False) -> list[np.ndarray]:
    """``w`` after one round for each rate: partitions train on all their rows (``half``: on every other), weights are averaged by rows."""
    for k, rate in enumerate(rates):
        def local(x: np.ndarray, w=w, rate=rate, k=k) -> tuple[int, np.ndarray, np.ndarray]:
            u = np.clip((x[::2] if half else x) - mean, -6 * scale, 6 * scale) / scale
            rng = np.random.default_rng([3, k, TaskContext.get().partitionId()])
            return len(u), len(u) * _flat(train(w, p, u.astype(np.float32), prior, rate, rng)), np.zeros(len(_flat(w)))

        n, total, _ = _summed(measures, local, len(_flat(w)))
        w = _shaped(total / n, w)
    return w


def estimate_prior(measures: DataFrame, p: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """Upper bound of the share of positives among all rows, from scores of positives that the classifier was not fitted to."""
    w = averaged_training(measures, p[::2], initial_weights(p.shape[1]), None, FIRST_RATES, mean, scale, half=True)
    sp = np.sort(_forward(w, p[1::2])[1])
    cuts = np.quantile(sp, np.linspace(0.02, 0.9, 45))  # at least a tenth of the positives above each

    def above(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        s = np.sort(_forward(w, np.clip((x - mean) / scale, -6, 6))[1])
        return len(s), len(s) - np.searchsorted(s, cuts), np.zeros(len(cuts))

    n, counts, _ = _summed(measures, above, len(cuts))
    share_p, share_u = 1 - np.searchsorted(sp, cuts) / len(sp), counts / n
    slack = math.sqrt(math.log(20) / (2 * n)) + math.sqrt(math.log(20) / (2 * len(sp)))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(min(0.98, max(0.05, share_u[best] / share_p[best])))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the measures of every row's text (null counts as empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(batch_texts(b, "text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.ravel()))],
                                             names=["id", "x"])
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, x array<float>")


def fit_quality(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_positives: int = MAX_POSITIVES) -> QualityModel:
    """Fit to the texts of ``docs`` whose ids are in ``positives``, and to all texts of ``docs`` as unlabelled.

    Positives: the ``max_positives`` ids that are smallest by hash (the bounded labelled sample; one row an id); null ids are
    none. Every row of ``docs`` is unlabelled text, repeated rows each. With fewer than two of either the model gives the
    prior 0.5 to every text. Actions: the measures are written, and each round is one pass over them.
    """
    measures = materialise(measured(docs, id_col, text_col))
    ids = positives.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(max_positives)
    rows = measures.join(chosen, "id", "left_semi").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").limit(max_positives)
    p = np.array([r["x"] for r in rows.select("x").collect()], float).reshape(-1, N_FEATURES)
    n, total, squares = _summed(measures, lambda x: (len(x), x.sum(0, dtype=float), np.square(x, dtype=float).sum(0)), N_FEATURES)
    if len(p) < 2 or n < 2:
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(N_FEATURES), np.zeros(1)], 0.5)
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 1e-3
    p = np.clip((p - mean) / scale, -6, 6)
    p = p[np.random.default_rng(3).permutation(len(p))]
    prior = estimate_prior(measures, p, mean, scale)
    return QualityModel(mean, scale, averaged_training(measures, p, initial_weights(N_FEATURES), prior, RATES, mean, scale), prior)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD,
                  names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better text) and predicted (1 if score >= threshold, else 0).

    Every row keeps its columns (those of the two added names are replaced). Null texts count as empty; texts
    without words all get the same score. Only the text counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            s = model.scores(_matrix(batch_texts(b, text_col))) if b.num_rows else np.zeros(0)
            yield [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

    return map_with_columns(docs, [(names[0], T.DoubleType()), (names[1], T.IntegerType())], run)
