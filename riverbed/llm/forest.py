"""A random forest: fitted with numpy on a bounded sample, applied as one Spark expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tree(x, y, rng, depth, least, tries):
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return p
    best = None
    for f in rng.choice(x.shape[1], tries, replace=False):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        for cut in middles if len(middles) <= 12 else rng.choice(middles, 12, replace=False):
            left = x[:, f] < cut
            n = int(left.sum())
            if least <= n <= len(y) - least:
                a, b = y[left].mean(), y[~left].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0]:
                    best = impurity, int(f), float(cut), left
    if best is None:
        return p
    _, f, cut, left = best
    return f, cut, _tree(x[left], y[left], rng, depth - 1, least, tries), _tree(x[~left], y[~left], rng, depth - 1, least, tries)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 7, least: int = 3, seed: int = 5) -> list:
    """Trees over bootstrap samples, each split chosen among a random share of the features."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_tree(x[rows], y[rows].astype(float), rng, depth, least, max(1, int(np.sqrt(x.shape[1])) + 1)))
    return out


def apply(forest: list, feature) -> Column:
    """Mean of the trees' leaves; feature(k) is the Column of the k-th feature."""

    def node(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        f, cut, low, high = t
        return F.when(feature(f) < F.lit(cut), node(low)).otherwise(node(high))

    total = F.lit(0.0)
    for t in forest:
        total = total + node(t)
    return total / len(forest)
