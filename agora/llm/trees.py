"""Small boosted regression trees on a bounded sample, and their paths as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Path:
    """A conjunction of (feature, above, threshold): value > threshold, or <= if not above."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for feature, above, threshold in self.parts:
            out &= (x[:, feature] > threshold) == above
        return out

    def column(self, columns: list[Column]) -> Column:
        out = F.lit(True)
        for feature, above, threshold in self.parts:
            one = columns[feature] > F.lit(threshold)
            out &= one if above else ~one
        return out


@dataclass
class Boosted:
    base: float = 0.0
    trees: list[list[tuple[Path, float]]] = field(default_factory=list)  # leaves and their values

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for leaves in self.trees:
            for path, value in leaves:
                out += value * path.holds(x)
        return out

    def kept(self, n: int) -> Boosted:
        """The first n trees."""
        return Boosted(self.base, self.trees[:n])

    def column(self, columns: list[Column]) -> Column:
        """The log odds as an expression: each tree is nested CASEs over its leaves."""
        out = F.lit(self.base)
        for leaves in self.trees:
            one = F.lit(leaves[-1][1])
            for path, value in reversed(leaves[:-1]):
                one = F.when(path.column(columns), F.lit(value)).otherwise(one)
            out = out + one
        return out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds of each feature: midpoints of distinct values, or of quantiles."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(values, np.linspace(0, 1, bins)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0, share: float = 1.0, seed: int = 5) -> Boosted:
    """Logistic gradient boosting with Newton leaves; histograms over at most `bins` thresholds."""
    if not len(y):
        return Boosted()
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))))
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if x.shape[1] else x
    raw = np.full(len(y), model.base)
    rnd = np.random.default_rng(seed)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        rows = np.flatnonzero(rnd.random(len(y)) < share) if share < 1 else np.arange(len(y))
        leaves: list[tuple[Path, float]] = []
        open_ = [((), rows)]
        while open_:
            parts, own = open_.pop()
            g, h = slope[own].sum(), curve[own].sum()
            best = (1e-6, None)
            if len(parts) < depth:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.cumsum(np.bincount(binned[own, j], slope[own], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[own, j], curve[own], len(e) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(hs < least) | (h - hs < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k))
            if best[1] is None:
                leaves.append((Path(tuple(parts)), float(rate * g / (h + 1))))
                continue
            j, k = best[1]
            above = binned[own, j] > k
            t = float(edges[j][k])
            open_.append(((*parts, (j, True, t)), own[above]))
            open_.append(((*parts, (j, False, t)), own[~above]))
        for path, value in leaves:
            raw += value * path.holds(x)
        model.trees.append(leaves)
    return model
