"""A small causal self-attention model over subword slots, in numpy: scoring, gradients and local training.

Slots: the most frequent subword ids have a slot of their own, all others share the last one, within which their
corpus frequencies decide. The ``DIRECT`` most frequent slots stand in the first softmax themselves; the others form
groups that stand there as one entry each, and a second softmax chooses within the group. So a token costs one or
two short softmaxes instead of one over the vocabulary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

WIDTH = 16
WINDOW = 32
STRIDE = 26
DIRECT = 40
GROUPS = 24
SIZE = 96
SLOTS = DIRECT + GROUPS * SIZE
#: Windows attended to at once, and rows of logits made at once: small enough for the cache.
WINDOWS_AT_ONCE = 80
ROWS_AT_ONCE = 2048
#: Likewise in training, and weights updated at once.
TRAINED_AT_ONCE = 512
UPDATED_AT_ONCE = 8192


@dataclass
class Vocabulary:
    """slot_of: slot of every id; inside: natural-log probability of an id within its slot."""

    slot_of: np.ndarray
    inside: np.ndarray
    counts: np.ndarray  # by slot


def vocabulary_of(counts: np.ndarray) -> Vocabulary:
    """``counts``: how often each id is in the training texts (the last id is the end of a text)."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    slot_of = np.full(len(counts), SLOTS - 1, np.uint16)
    head = order[:SLOTS - 1]
    slot_of[head] = np.arange(len(head))
    inside = np.zeros(len(counts), np.float32)
    tail = order[SLOTS - 1:]
    if len(tail):
        inside[tail] = np.log((counts[tail] + 1) / (counts[tail] + 1).sum())
    return Vocabulary(slot_of, inside, np.bincount(slot_of, weights=counts, minlength=SLOTS))


def _entries(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of the first softmax and place in the group (of no meaning for direct slots)."""
    group, place = np.divmod(y - DIRECT, SIZE)
    return np.where(y < DIRECT, y, DIRECT + group), place


def initial_weights(vocabulary: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Starts as the unigram model of the corpus."""
    rng = np.random.default_rng(seed)
    n = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    counts = vocabulary.counts[DIRECT:].reshape(GROUPS, SIZE)
    first = np.concatenate([vocabulary.counts[:DIRECT], counts.sum(1)])
    inner = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    return {"ein": n(SLOTS, WIDTH, s=0.3), "eout": n(GROUPS * SIZE, WIDTH, s=0.1), "bout": inner.reshape(-1).astype(np.float32),
            "ecl": n(DIRECT + GROUPS, WIDTH, s=0.1), "bcl": np.log((first + 1) / (first + 1).sum()).astype(np.float32),
            "wq": n(WIDTH, WIDTH, s=0.25), "wk": n(WIDTH, WIDTH, s=0.25), "wv": n(WIDTH, WIDTH, s=0.25), "wo": n(WIDTH, WIDTH, s=0.25),
            "rel": (-0.1 * np.arange(WINDOW)).astype(np.float32)}


def flatten(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_LAG = np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW))
_FUTURE = _LAG < 0
_PLACES = np.arange(SLOTS * WIDTH).reshape(SLOTS, WIDTH)


def _masked_bias(w: dict[str, np.ndarray], length: int) -> np.ndarray:
    return np.where(_FUTURE, np.float32(-1e9), w["rel"][np.abs(_LAG)])[:length, :length]


def _projections(w: dict[str, np.ndarray]) -> np.ndarray:
    """Queries (over the root of the width), keys and values side by side."""
    return np.concatenate([w["wq"] / math.sqrt(WIDTH), w["wk"], w["wv"]], 1)


def _exp_(scores: np.ndarray, bound: float, most: int) -> None:
    """Exponentials in place; beyond ``most`` they would leave the range of 32-bit numbers. ``bound``: at least every score."""
    if not bound <= most:
        np.minimum(scores, most, out=scores)
    np.exp(scores, out=scores)


def _attend(w: dict[str, np.ndarray], x: np.ndarray) -> tuple:
    """Masked attention over windows of slots ``x`` (windows, positions): all that the backward pass needs.

    Flat inputs, queries and keys beside the values and a column of ones, the values with that column, the exponentials of the
    scores, the reciprocals of their sums, what is mixed (over the sums already), and the states. The exponentials are never
    divided: the column of ones gives their sums, and rows are scaled where they are narrow.
    """
    z = w["ein"].take(x.reshape(-1), 0)
    wide = np.ones((*x.shape, 3 * WIDTH + 1), z.dtype)
    wide[..., :-1] = (z @ _projections(w)).reshape(*x.shape, 3 * WIDTH)
    q, k = wide[..., :WIDTH], wide[..., WIDTH:2 * WIDTH]
    e = q @ k.transpose(0, 2, 1)
    e += _masked_bias(w, x.shape[1])
    _exp_(e, _longest(q) * _longest(k) + float(w["rel"].max()), 60)
    value = wide[..., 2 * WIDTH:]
    mixed = e @ value
    scale = 1 / np.maximum(mixed[..., WIDTH:], 1e-30)
    mixed = (mixed[..., :WIDTH] * scale).reshape(-1, WIDTH)
    return z, wide, value, e, scale, mixed, (z + mixed @ w["wo"]).reshape(*x.shape, WIDTH)


def _longest(rows: np.ndarray) -> float:
    """Length of the longest row."""
    return math.sqrt(np.einsum("...i,...i->...", rows, rows).max())


def states(w: dict[str, np.ndarray], x: np.ndarray, skip: int = 0) -> np.ndarray:
    """The last item of ``_attend`` from position ``skip`` on, with fewer products."""
    z = w["ein"].take(x.reshape(-1), 0).reshape(*x.shape, WIDTH)
    late = z[:, skip:]
    q = (late.reshape(-1, WIDTH) @ (w["wq"] / math.sqrt(WIDTH))).reshape(late.shape)
    kv = z.reshape(-1, WIDTH) @ np.concatenate([w["wk"], w["wv"] @ w["wo"]], 1)
    value = np.ones((*x.shape, WIDTH + 1), kv.dtype)
    value[..., :WIDTH] = kv[:, WIDTH:].reshape(z.shape)
    k = kv[:, :WIDTH].reshape(z.shape)
    s = q @ k.transpose(0, 2, 1)
    s += _masked_bias(w, x.shape[1])[skip:]
    _exp_(s, _longest(q) * _longest(k) + float(w["rel"].max()), 60)
    mixed = s @ value
    return late + mixed[..., :WIDTH] / np.maximum(mixed[..., WIDTH:], 1e-30)


def _exp_errors_(logits: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, float]:
    """Turns ``logits`` into the softmax less the one-hot of ``y``, times each row's sum of exponentials.

    Returns the reciprocals of the sums, as a column, and the sum of the log probabilities of ``y``.
    """
    rows = np.arange(len(y))
    chosen = logits[rows, y]
    _exp_(logits, bound, 80)
    total = np.maximum(logits @ np.ones(logits.shape[1], logits.dtype), 1e-30)
    logits[rows, y] -= total
    return (1 / total)[:, None], float((np.minimum(chosen, 80) - np.log(total)).sum())


def _by_group(entry: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows of each group that has some; direct slots are in none."""
    rows = np.flatnonzero(entry >= DIRECT)
    group = entry[rows] - DIRECT
    rows = rows[np.argsort(group.astype(np.uint8), kind="stable")]
    edges = np.cumsum(np.bincount(group, minlength=GROUPS))
    return [(g, rows[a:b]) for g, (a, b) in enumerate(zip(np.concatenate([[0], edges[:-1]]), edges)) if b > a]


def _log_prob_of(logits: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    chosen = np.minimum(logits[np.arange(len(y)), y], 80)
    _exp_(logits, bound, 80)
    return chosen - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def log_probs(w: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural-log probability of each slot ``y`` after the state ``h``.

    Logits are made ``ROWS_AT_ONCE`` rows at a time, which keeps them in the cache; the bias is a last row of the weights.
    """
    out = np.empty(len(y), np.float32)
    wide = np.ones((len(y), WIDTH + 1), h.dtype)
    wide[:, :WIDTH] = h
    reach = _longest(h) if len(y) else 0.0
    head, bound = np.concatenate([w["ecl"].T, w["bcl"][None]]), reach * _longest(w["ecl"]) + float(w["bcl"].max())
    entry, inner = _entries(y)
    for i in range(0, len(y), ROWS_AT_ONCE):
        part = slice(i, i + ROWS_AT_ONCE)
        out[part] = _log_prob_of(wide[part] @ head, entry[part], bound)
    eout, bout = w["eout"].reshape(GROUPS, SIZE, WIDTH), w["bout"].reshape(GROUPS, SIZE)
    bound = reach * _longest(w["eout"]) + float(w["bout"].max())
    for c, at in _by_group(entry):
        weights = np.concatenate([eout[c].T, bout[c][None]])
        for i in range(0, len(at), ROWS_AT_ONCE):
            rows = at[i:i + ROWS_AT_ONCE]
            out[rows] += _log_prob_of(wide.take(rows, 0) @ weights, inner[rows], bound)
    return out


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of these lengths laid end to end: each window's text, its first position, and whether it is the text's first."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return text, k * STRIDE, k == 0


def score_tokens(w: dict[str, np.ndarray], slots: np.ndarray, lengths: np.ndarray, start_slot: int) -> np.ndarray:
    """Natural-log probability of every token of texts laid end to end, each scored once.

    A window sees up to ``WINDOW`` inputs; it scores its last ``STRIDE`` positions (the first window of a text all),
    so that later windows overlap the one before by ``WINDOW - STRIDE`` positions of context.
    """
    first = np.cumsum(lengths) - lengths
    inputs = np.empty_like(slots)
    inputs[1:] = slots[:-1]
    inputs[first] = start_slot
    text, start, is_first = windows_of(lengths)
    state, where, filled = np.empty((len(slots), WIDTH), np.float32), np.empty(len(slots), np.int64), 0
    for some, skip in ((np.flatnonzero(is_first), 0), (np.flatnonzero(~is_first), WINDOW - STRIDE)):
        for i in range(0, len(some), WINDOWS_AT_ONCE):
            t, s = text[some[i:i + WINDOWS_AT_ONCE]], start[some[i:i + WINDOWS_AT_ONCE]]
            place = s[:, None] + np.arange(WINDOW)
            inside = place < lengths[t][:, None]
            width = int(inside.sum(1).max())
            place, scored = place[:, :width], inside[:, skip:width]
            at = first[t][:, None] + np.minimum(place, lengths[t][:, None] - 1)
            h = states(w, inputs[at], skip)[scored]
            state[filled:filled + len(h)], where[filled:filled + len(h)] = h, at[:, skip:][scored]
            filled += len(h)
    out = np.zeros(len(slots), np.float32)
    out[where[:filled]] = log_probs(w, state[:filled], slots[where[:filled]].astype(np.int64))
    return out


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, valid: np.ndarray,
              into: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the mean negative log probability of ``y`` at the valid positions (written to ``into``); and that mean."""
    z, wide, value, e, scale, mixed, hidden = _attend(w, x)
    whole = bool(valid.all())
    target = (y.reshape(-1) if whole else y[valid]).astype(np.int64)
    n = len(target)
    g = {name: np.empty_like(p) for name, p in w.items()} if into is None else into
    h = np.ones((n, WIDTH + 1), hidden.dtype)
    h[:, :-1] = hidden.reshape(-1, WIDTH) if whole else hidden[valid]
    entry, place = _entries(target)
    reach = _longest(h[:, :-1])  # no logit is above this times the length of its output vector, and the bias
    head, log_prob = np.concatenate([w["ecl"], w["bcl"][:, None]], 1), 0.0
    dh, both, bound = np.empty((n, WIDTH), h.dtype), 0, reach * _longest(w["ecl"]) + float(w["bcl"].max())
    for i in range(0, n, TRAINED_AT_ONCE):
        part = slice(i, i + TRAINED_AT_ONCE)
        d = h[part] @ head.T
        over, more = _exp_errors_(d, entry[part], bound)
        log_prob += more
        over /= n
        both = both + d.T @ (h[part] * over)
        np.multiply(d @ w["ecl"], over, out=dh[part])
    g["ecl"][:], g["bcl"][:] = both[:, :-1], both[:, -1]
    # Second softmax: rows in the order of their groups, so that only the products are made group by group.
    groups = _by_group(entry)
    both = np.zeros((GROUPS * SIZE, WIDTH + 1), h.dtype)
    if groups:
        rows = np.concatenate([at for _, at in groups])
        ends = np.cumsum([len(at) for _, at in groups]).tolist()
        parts = [(slice(a, b), slice(c * SIZE, (c + 1) * SIZE)) for (c, _), a, b in zip(groups, [0, *ends], ends)]
        out = np.concatenate([w["eout"], w["bout"][:, None]], 1)
        own, d, inner = h.take(rows, 0), np.empty((len(rows), SIZE), h.dtype), np.empty((len(rows), WIDTH), h.dtype)
        for part, group in parts:
            np.matmul(own[part], out[group].T, out=d[part])
        over, more = _exp_errors_(d, place[rows], reach * _longest(w["eout"]) + float(w["bout"].max()))
        log_prob += more
        over /= n
        own *= over
        for part, group in parts:
            np.matmul(d[part].T, own[part], out=both[group])
            np.matmul(d[part], w["eout"][group], out=inner[part])
        inner *= over
        dh[rows] += inner
    g["eout"][:], g["bout"][:] = both[:, :-1], both[:, -1]
    if whole:
        back = dh
    else:
        back = np.zeros((x.size, WIDTH), h.dtype)
        back[valid.reshape(-1)] = dh
    g["wo"][:] = mixed.T @ back
    dm = back @ w["wo"].T
    # With a = e * scale: d score = a * (dm v' - dm mixed'), where the second term is a column beside the values' column of ones.
    side = np.empty((*x.shape, WIDTH + 1), h.dtype)
    side[..., :-1] = dm.reshape(*x.shape, WIDTH)
    side[..., -1] = -np.einsum("ij,ij->i", dm, mixed).reshape(x.shape)
    side *= scale
    ds = side @ value.transpose(0, 2, 1)
    ds *= e
    length = x.shape[1]
    lag = np.maximum(_LAG[:length, :length], 0)
    g["rel"][:] = np.bincount(lag.reshape(-1), weights=(np.ones(len(x), h.dtype) @ ds.reshape(len(x), -1)), minlength=WINDOW)
    dp = np.empty((*x.shape, 3 * WIDTH), h.dtype)
    np.matmul(ds, wide[..., WIDTH:2 * WIDTH], out=dp[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), wide[..., :WIDTH], out=dp[..., WIDTH:2 * WIDTH])
    np.matmul(e.transpose(0, 2, 1), side[..., :-1], out=dp[..., 2 * WIDTH:])
    dp = dp.reshape(-1, 3 * WIDTH)
    both = z.T @ dp
    g["wq"][:], g["wk"][:], g["wv"][:] = both[:, :WIDTH] / math.sqrt(WIDTH), both[:, WIDTH:2 * WIDTH], both[:, 2 * WIDTH:]
    dz = dp @ _projections(w).T
    dz += back
    g["ein"][:] = 0
    np.add.at(g["ein"].reshape(-1), _PLACES.take(x.reshape(-1), 0).reshape(-1), dz.reshape(-1))
    return g, -log_prob / n


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parts of ``flat`` (as ``flatten`` lays them) in the shapes of ``like``."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train_locally(w: dict[str, np.ndarray], batches, rate: float = 0.01) -> tuple[dict[str, np.ndarray], int]:
    """Adam over the batches (x, y, valid) once; the weights and the number of tokens seen.

    Weights, gradients and both moments lie in one array each and are updated a piece at a time that stays in the cache. The
    moments are kept without their factors 0.1 and 0.01.
    """
    flat = flatten(w)
    grad, m, s = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    w, g = _views(flat, w), _views(grad, w)
    tokens = step = 0
    for x, y, valid in batches:
        step += 1
        gradients(w, x, y, valid, g)
        up = flat.dtype.type(0.1 * rate * min(1, step / 20) / (1 - 0.9 ** step))
        under = flat.dtype.type(math.sqrt(0.01 / (1 - 0.99 ** step)))
        for i in range(0, len(flat), UPDATED_AT_ONCE):
            part = slice(i, i + UPDATED_AT_ONCE)
            d, first, second = grad[part], m[part], s[part]
            first *= 0.9
            first += d
            second *= 0.99
            np.multiply(d, d, out=d)
            second += d
            np.sqrt(second, out=d)
            d *= under
            d += 1e-6
            np.divide(first, d, out=d)
            d *= up
            flat[part] -= d
        tokens += int(valid.sum())
    return w, tokens
