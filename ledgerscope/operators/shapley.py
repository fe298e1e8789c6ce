"""Path-dependent Shapley values of isolation trees, leaf by leaf.

The value of a feature set S at a row is the tree's path length when splits on S follow the row and the others send it
both ways by the share of sampled rows (Lundberg et al., 2020). A leaf then counts with the product, over the features
on its path, of 1 or 0 (in S: does the row meet the path's interval?) and of the shares (not in S). For a feature i
of the leaf the sum over all sets is a polynomial: the product over the other features of (share + met * t), whose
coefficient of t^k sums the sets of size k, weighted by k! (u - k - 1)! / u!. What a row meets at a leaf of u features
is a pattern of u bits, so each leaf has a table of 2^u patterns, made once, and a row looks its pattern up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Rows and leaves worked on at once.
ROWS, LEAVES = 128, 4096


def subset_weights(u: int) -> np.ndarray:
    """Shapley weight of a set of k other features, k from 0 to u - 1."""
    return np.array([math.factorial(k) * math.factorial(u - k - 1) / math.factorial(u) for k in range(u)])


def leaves(tree: dict) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(path length, feature -> (share, least, bound)) of each leaf; the interval is [least, bound)."""
    stack = [(0, 0, {})]
    while stack:
        node, depth, path = stack.pop()
        f = int(tree["feature"][node])
        if f < 0:
            yield depth + float(tree["leaf_c"][node]), path
            continue
        share, least, bound = path.get(f, (1.0, -math.inf, math.inf))
        at, size = float(tree["threshold"][node]), float(tree["size"][node])
        for child, lo, hi in ((int(tree["left"][node]), least, min(bound, at)), (int(tree["right"][node]), max(least, at), bound)):
            stack.append((child, depth + 1, {**path, f: (share * float(tree["size"][child]) / size, lo, hi)}))


def pattern_tables(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """[leaf, pattern, place]: contribution of the feature at each place, for every pattern of met features."""
    n, u = share.shape
    met = (np.arange(1 << u)[:, None] >> np.arange(u) & 1).astype(float)
    weights = subset_weights(u)
    out = np.empty((n, 1 << u, u))
    for i in range(u):
        poly = np.ones((n, 1 << u, 1))
        for j in range(u):
            if j != i:
                grown = np.zeros((n, 1 << u, poly.shape[2] + 1))
                grown[:, :, :-1] += poly * share[:, None, j, None]
                grown[:, :, 1:] += poly * met[None, :, j, None]
                poly = grown
        out[:, :, i] = (poly @ weights) * (met[None, :, i] - share[:, None, i]) * value[:, None]
    return out


class ForestShapley:
    """Tables of all leaves of a forest; ``values`` gives each row's contributions to its mean path length."""

    def __init__(self, trees: list[dict], features: int):
        self.features, self.expected = features, 0.0
        grouped: dict[int, list] = {}
        for tree in trees:
            for length, path in leaves(tree):
                weight = math.prod(p[0] for p in path.values())
                self.expected += length * weight / len(trees)
                if path:
                    grouped.setdefault(len(path), []).append((length / len(trees), sorted(path.items())))
        self.groups = []
        for u, some in sorted(grouped.items()):
            for a in range(0, len(some), LEAVES):
                part = some[a:a + LEAVES]
                place = np.array([[f for f, _ in p] for _, p in part])
                share, least, bound = (np.array([[v[k] for _, v in p] for _, p in part]) for k in range(3))
                to_feature = (place.reshape(-1)[:, None] == np.arange(features)).astype(float)
                self.groups.append((u, place, least, bound, pattern_tables(share, np.array([v for v, _ in part])), to_feature))

    def values(self, x: np.ndarray) -> np.ndarray:
        """[row, feature] contributions; they sum to the row's mean path length less ``expected``."""
        out = np.zeros((len(x), self.features))
        for a in range(0, len(x), ROWS):
            rows = x[a:a + ROWS]
            for u, place, least, bound, table, to_feature in self.groups:
                at = rows[:, place]
                # as the descent does: to the left if below the threshold, else (also when missing) to the right
                met = np.where(np.isnan(at), bound == np.inf, ~(at < least) & (at < bound))
                pattern = met @ (1 << np.arange(u))
                parts = table[np.arange(len(place)), pattern]
                out[a:a + ROWS] += parts.reshape(len(rows), -1) @ to_feature
        return out
