"""Quality by a sparse ensemble of rules: tree paths, lasso weights, column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.quality_rules import IS_LOWER, IS_SEPARATOR, IS_STOP, IS_UPPER, Rules, _sums, _table, judge
from agora.llm.scratch import whole_texts
from agora.llm.textarrays import Chunk, chunks, first_of_each, word_numbers
from agora.llm.trees import Path, boost

#: The statistics of a text that rules are made of.
STATISTICS = ("words", "word_length", "symbols", "separators", "exclamations", "stops", "upper", "digits", "repeat_share", "distinct_share", "dup_lines", "line_words", "longest_run", "wide")


def statistics(chunk: Chunk) -> np.ndarray:
    """texts x STATISTICS; shares and means over nothing are 0."""
    data, at = chunk.data, chunk.offsets
    found = judge(chunk, Rules())

    def count(marks: np.ndarray) -> np.ndarray:
        sums = _sums(marks)
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    n_words = found["n_words"].astype(float)
    per_word = np.maximum(n_words, 1)
    upper, lower = count(IS_UPPER[data]), count(IS_LOWER[data])
    starts, ends, first = chunk.words()
    numbers, _ = word_numbers(data, starts, ends)
    owner = np.repeat(np.arange(chunk.n), np.diff(first))
    distinct = np.bincount(owner[first_of_each(owner, numbers)], minlength=chunk.n)
    same = (numbers[1:] == numbers[:-1]) & (owner[1:] == owner[:-1])
    run = np.bincount(owner[1:][same], minlength=chunk.n)
    line_starts, _ = chunk.edges(data != 10)
    lines = np.bincount(np.searchsorted(at, line_starts, "right") - 1, minlength=chunk.n) if len(line_starts) else np.zeros(chunk.n)
    columns = (
        n_words,
        found["word_chars"] / per_word,
        found["n_symbols"] / per_word,
        count(IS_SEPARATOR[data]) / per_word,
        count(_table(b"!")[data]) / per_word,
        count(IS_STOP[data]) / per_word,
        upper / np.maximum(upper + lower, 1),
        count(_table(b"0123456789")[data]) / per_word,
        found["n_repeat_words"] / per_word,
        distinct / per_word,
        found["n_dup_lines"] / np.maximum(lines, 1),
        n_words / np.maximum(lines, 1),
        run / per_word,
        count(data >= 128) / np.maximum(np.diff(at), 1),
    )
    return np.stack(columns, 1)


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs and the statistics of its texts, as columns s_<name>."""
    return _with_statistics(docs, keep, text).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def _with_statistics(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """with_statistics() with the columns to keep named k0, k1, ..."""
    kinds, place = dict(docs.dtypes), keep.index(text) if text in keep else len(keep)
    schema = ", ".join([f"k{i} {kinds[c]}" for i, c in enumerate(keep)] + [f"s_{s} double" for s in STATISTICS])
    names = [f"k{i}" for i in range(len(keep))] + [f"s_{s}" for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(place)):
                values = statistics(chunk)
                kept = [batch.column(i).slice(chunk.first, chunk.n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(values[:, j]) for j in range(values.shape[1]))], names)

    return whole_texts(docs).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(text).alias("t")])).mapInArrow(run, schema)


@dataclass(frozen=True)
class Params:
    """`rows` bounds the labelled sample; the rest shapes trees and the penalty."""

    rows: int = 20_000
    rounds: int = 24
    depth: int = 3
    penalty: float = 0.002
    steps: int = 400
    seed: int = 23


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Path, float]]

    def score(self) -> Column:
        """The probability of label 1, from the columns of with_statistics()."""
        columns = [F.col(f"s_{s}") for s in STATISTICS]
        total = F.lit(self.intercept)
        for path, weight in self.rules:
            total = total + F.when(path.column(columns), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for path, weight in self.rules:
            total += weight * path.holds(x)
        return 1 / (1 + np.exp(-total))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    x = np.column_stack([np.ones(len(x)), x])
    size = 4 * len(x) / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y) / len(y)
        new = ahead - size * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (was - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, params: Params = Params()) -> Model:
    """Every path of the trees, inner nodes too, is a rule; the lasso keeps a few."""
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else (6.0 if y[0] else -6.0), [])
    paths: set[Path] = set()
    for k in range(1, params.depth + 1):
        for leaves in boost(x, y, params.rounds // params.depth, k, share=0.7, seed=params.seed + k).trees:
            for path, _ in leaves:
                paths |= {Path(path.parts[:i]) for i in range(1, len(path.parts) + 1)}
    found, seen = [], set()
    for path in sorted(paths, key=lambda p: (len(p.parts), p.parts)):
        holds = path.holds(x)
        if 0 < holds.sum() < len(x) and (mark := holds.tobytes()) not in seen and (~holds).tobytes() not in seen:
            seen.add(mark)
            found.append((path, holds))
    if not found:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), [])
    intercept, weights = lasso(np.stack([h for _, h in found], 1).astype(float), y, params.penalty, params.steps)
    return Model(intercept, [(p, float(w)) for (p, _), w in zip(found, weights, strict=True) if abs(w) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most about params.rows labelled rows, those of smallest hash; null labels are left out."""
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y")).where("y is not null and id is not null").distinct()
    n = marked.count()
    share = min(1.0, params.rows / max(n, 1))
    marked = marked.where(F.pmod(F.xxhash64("id", F.lit(params.seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # The sample is bounded by params.rows, so it may be broadcast.
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(marked), "id")
    # A key that documents repeat teaches once, by its least text.
    sample = sample.groupBy("id", "y").agg(F.min("t").alias("t"))
    got = with_statistics(sample, ["y"], "t").collect()
    values = np.array([[r["y"], *r[1:]] for r in got]).reshape(len(got), 1 + len(STATISTICS))
    values = values[np.lexsort(values.T)]
    return fit_rules(values[:, 1:], (values[:, 0] > 0).astype(float), params)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every row, score in 0 to 1 and predicted (1 from 0.5 on).

    Null and empty texts are scored by statistics that are all 0. Equal texts get equal
    scores; repeated rows stay; an empty table gives an empty table; other columns are
    ignored. Without labels the score is 0.5.
    """
    out = with_statistics(docs, keep, text).withColumn("score", model.score())
    return out.select(*keep, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that score() predicts to be bad, whatever its columns are called."""
    rows = _with_statistics(docs, docs.columns, text).where(model.score() >= 0.5)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
