"""Nonlinear reduction of vectors: a spectral embedding of their graph over landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.neighbours import clean, distances, smallest


@dataclass
class Spectral:
    """Landmarks (count x dims), how many of them describe a row, and what each is worth in every new dimension."""

    landmarks: np.ndarray
    near: int
    basis: np.ndarray

    def weights(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest landmarks of each row and their weights, which sum to 1 and fall with the distance against that of the farthest of them."""
        d = distances(x, self.landmarks)
        # One landmark more than is used gives the scale, so none of those used has weight 0.
        k = min(self.near + 1, len(self.landmarks))
        place = smallest(d, k)
        d = np.take_along_axis(d, place, 1)
        scale = np.maximum(d[:, -1:], 1e-12)
        place, d = place[:, : self.near], d[:, : self.near]
        w = np.exp(-((d / scale) ** 2) * 2)
        return place, w / w.sum(1, keepdims=True)

    def transform(self, rows: DataFrame, column: str = "embedding", out: str = "reduced") -> DataFrame:
        """rows with `out`: the place of a vector in the new dimensions, whether it was there at the fit or not; null without a vector."""

        def place(column: pd.Series) -> pd.Series:
            found: list[np.ndarray | None] = [None] * len(column)
            some = [i for i, v in enumerate(column) if v is not None and len(v)]
            if some:
                near, w = self.weights(np.stack([column.iloc[i] for i in some]))
                for i, y in zip(some, np.einsum("nk,nkr->nr", w, self.basis[near]), strict=True):
                    found[i] = y
            return pd.Series(found)

        return rows.withColumn(out, F.pandas_udf(place, "array<double>")(clean(column)))


def fit(rows: DataFrame, dims: int, key: str = "vec_id", column: str = "embedding", landmarks: int = 512, near: int = 5) -> Spectral:
    """The spectral embedding of the graph that joins rows over the landmarks they share.

    Landmarks are rows drawn by hash of their key, a bounded number. Every row is described
    by its `near` nearest ones, with weights z; two rows are tied by z L^-1 z', L being the
    landmarks' sums. The leading eigenvectors of that graph over all rows are those of a
    matrix of landmarks by landmarks, which tasks sum up over all rows; the constant one is
    left out. A row's place is its weights times the landmarks' values, so new rows need
    no new fit.
    """
    table = rows.select(key, clean(column).alias("e")).where("e is not null and size(e) > 0")
    size = table.count()
    if not size:
        raise ValueError("there are no vectors")
    share = min(1 << 20, (2 * landmarks + 64) * (1 << 20) // size + 1)
    drawn = table.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share).orderBy(F.xxhash64(key), key).limit(landmarks)
    # Copies of a landmark would take the places of others.
    marks = np.unique(np.array([r.e for r in drawn.collect()], float), axis=0)
    model = Spectral(marks, min(near, len(marks)), np.zeros((len(marks), dims)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(marks), len(marks)))
        for part in batches:
            place, w = model.weights(np.stack(part["e"].to_numpy()))
            for i in range(place.shape[1]):
                for j in range(place.shape[1]):
                    np.add.at(total, (place[:, i], place[:, j]), w[:, i] * w[:, j])
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "w": total[i, j]})

    gram = np.zeros((len(marks), len(marks)))
    # At most landmarks x landmarks numbers, in one job.
    found = table.select("e").mapInPandas(sums, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).toArrow()
    gram[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("w").to_numpy()
    root = 1 / np.sqrt(np.maximum(gram.sum(1), 1e-12))
    values, vectors = np.linalg.eigh(gram * root[:, None] * root[None, :])
    order = np.argsort(-values)[1 : dims + 1]
    basis = root[:, None] * vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
    # Signs are free; the largest value of a dimension is positive.
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    model.basis = np.pad(basis * np.sqrt(size), ((0, 0), (0, dims - basis.shape[1])))
    return model
