"""Users whose hidden state moves with what they read, decides what they answer, and shows in what they write."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.ordered import numbered
from agora.sources.store import saved

#: Least distance between a state and a comment; its logarithm bounds what one choice can say.
NEAR = 0.01


@dataclass(frozen=True)
class Replies:
    """attention: the share of the way that a state moves to what is read. weight: choices go as
    distance ** -weight, error being its standard error. factors (dims x rank) and noise:
    what is written spreads around the state with covariance factors factors' + noise I."""

    attention: float
    weight: float
    error: float
    factors: np.ndarray
    noise: float

    @property
    def covariance(self) -> np.ndarray:
        return self.factors @ self.factors.T + self.noise * np.eye(len(self.factors))


def segments(rows: DataFrame, user: str, order: list[Column], wrote: str, seen: str, answered: str, dims: int, length: int = 256) -> DataFrame:
    """A saved row for each user and `length` steps in order: (user, segment, segments, steps), the third the user's number of them.

    A step is (place, wrote, seen, answered): a vector or null, the vectors that could be
    answered, and which was, from 0, or null. Places come by ranges, so a user who has a
    third of all steps is dealt over tasks.
    """
    vector = lambda v: F.transform(v, lambda x: x.cast("double"))
    step = rows.select(F.col(user).alias("user"), F.struct(*order).alias("o"), vector(F.col(wrote)).alias("wrote"), F.coalesce(F.transform(seen, vector), F.array().cast("array<array<double>>")).alias("seen"), F.col(answered).cast("int").alias("answered"))
    placed = numbered(step, ["user"], [F.col("o")])
    placed = placed.withColumn("segment", F.floor(F.col("place") / length)).withColumn("segments", F.ceil(F.col("place_of") / length))
    return saved(placed.groupBy("user", "segment", "segments").agg(F.array_sort(F.collect_list(F.struct("place", "wrote", "seen", "answered"))).alias("steps")), "segments")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of entries of each list (0 for null), and all entries."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column, nulls passed over."""
    n, values = _lists(column.drop_null())
    if (n != dims).any():
        raise ValueError(f"a vector has not {dims} numbers")
    return values.to_numpy(zero_copy_only=False).reshape(-1, dims)


class _Steps:
    """The steps of a batch of segments as arrays, segment after segment.

    moves is what a state moves towards (the comment answered, or the mean of all seen),
    has whether there is such. wrote, seen: vectors of the steps that have them.
    """

    def __init__(self, batch: pa.RecordBatch, dims: int, attend: str) -> None:
        self.length, steps = _lists(batch.column("steps"))
        self.begin = np.cumsum(self.length) - self.length
        fields = dict(zip([f.name for f in steps.type], steps.flatten(), strict=True))
        self.place, wrote, answered = fields["place"], fields["wrote"], fields["answered"]
        self.writes, self.wrote = wrote.is_valid().to_numpy(zero_copy_only=False), _vectors(wrote, dims)
        self.n_seen, seen = _lists(fields["seen"])
        if seen.null_count:
            raise ValueError("a comment seen has no vector")
        self.first, self.seen = np.cumsum(self.n_seen) - self.n_seen, _vectors(seen, dims)
        self.answers = answered.is_valid().to_numpy(zero_copy_only=False)
        self.answer = answered.fill_null(0).to_numpy(zero_copy_only=False)
        if (self.answers & ((self.answer < 0) | (self.answer >= self.n_seen))).any():
            raise ValueError("a comment answered is not among those seen")
        self.has, self.moves = self.n_seen > 0 if attend == "all" else self.answers, np.zeros((len(self.answer), dims))
        if attend == "all" and self.has.any():
            self.moves[self.has] = np.add.reduceat(self.seen, self.first[self.has]) / self.n_seen[self.has, None]
        elif attend != "all":
            self.moves[self.has] = self.seen[(self.first + self.answer)[self.has]]

    def walk(self, s: np.ndarray, d: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(states before each step, states after, their slopes by a; states and slopes at the ends), from one state and slope a segment.

        All segments take their first step at once, then all that have one their second.
        """
        before, after, slopes = np.zeros_like(self.moves), np.zeros_like(self.moves), np.zeros_like(self.moves)
        order = np.argsort(-self.length, kind="stable")
        begin, s, d = self.begin[order], s[order], d[order]
        for place, left in enumerate(np.searchsorted(-self.length[order], -np.arange(1, self.length.max(initial=0) + 1), "right")):
            at = begin[:left] + place
            before[at] = s[:left]
            has, gap = self.has[at, None], self.moves[at] - s[:left]
            d[:left] = np.where(has, (1 - a) * d[:left] + gap, d[:left])
            s[:left] += np.where(has, a * gap, 0.0)
            after[at], slopes[at] = s[:left], d[:left]
        ends = np.empty_like(s), np.empty_like(d)
        ends[0][order], ends[1][order] = s, d
        return before, after, slopes, *ends

    def moved(self) -> np.ndarray:
        """Moves in each segment."""
        return np.diff(np.concatenate([[0], np.cumsum(self.has)])[np.append(self.begin, len(self.has))])


def _starts(table: DataFrame, a: float, dims: int, attend: str) -> DataFrame:
    """(user, segment, s, d): the state and its slope at the start of each segment, 0 for a user's first.

    Both are linear in where a segment begins: after k moves a start (s, d) adds b ** k s to
    the state and b ** k d - k b ** (k - 1) s to the slope, with b = 1 - a. Segments are
    summed up alone, then a user's are joined in order: a short row for each, `length` times
    fewer than steps.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            steps, zero = _Steps(part, dims, attend), np.zeros((part.num_rows, dims))
            *_, s, d = steps.walk(zero, zero, a)
            yield pa.RecordBatch.from_arrays([part.column("user"), part.column("segment"), pa.array(steps.moved(), pa.int32()), _column(s), _column(d)], ["user", "segment", "k", "s", "d"])

    def carried(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("segment")
        s, d, starts = np.zeros(dims), np.zeros(dims), []
        for k, own_s, own_d in zip(part["k"], part["s"], part["d"], strict=True):
            starts.append((s, d))
            b = (1 - a) ** k
            s, d = b * s + own_s, b * d - (k * (1 - a) ** (k - 1) * s if k else 0.0) + own_d
        return part[["user", "segment"]].assign(s=[x[0] for x in starts], d=[x[1] for x in starts])

    kind = dict(table.dtypes)["user"]
    maps = table.mapInArrow(sums, f"user {kind}, segment long, k int, s array<double>, d array<double>")
    return maps.groupBy("user").applyInPandas(carried, f"user {kind}, segment long, s array<double>, d array<double>")


def _column(x: np.ndarray) -> pa.Array:
    """A list of doubles for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _are_cut(table: DataFrame) -> bool:
    """Whether any user has more than one segment."""
    return table.where("segments > 1").limit(1).count() > 0


def _with_starts(table: DataFrame, a: float, dims: int, attend: str, cut: bool) -> DataFrame:
    """table with s and d; a null user is a user. Only users with more than one segment (cut: there are such) need a join."""
    zero = F.array(*[F.lit(0.0)] * dims)
    alone = table.select("*", zero.alias("s"), zero.alias("d"))
    if not cut:
        return alone
    many = table.where("segments > 1")
    same = F.col("a.user").eqNullSafe(F.col("b.user")) & (F.col("a.segment") == F.col("b.segment"))
    return alone.where("segments = 1").unionByName(many.alias("a").join(_starts(many, a, dims, attend).alias("b"), same).select("a.*", "b.s", "b.d"))


def _expected(table: DataFrame, model: Replies, dims: int, attend: str, cut: bool = True) -> np.ndarray:
    """Sums over all steps that a round needs: of the slopes, of the residuals, and of the choices."""
    a, w, inverse = model.attention, model.weight, np.linalg.inv(model.covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6 + dims * dims)
        for part in batches:
            steps = _Steps(part, dims, attend)
            before, after, slopes, *_ = steps.walk(_vectors(part.column("s"), dims), _vectors(part.column("d"), dims), a)
            r, slope = steps.wrote - after[steps.writes], slopes[steps.writes]
            total[:3] += len(r), ((r @ inverse) * slope).sum(), ((slope @ inverse) * slope).sum()
            total[6:] += (r.T @ r).ravel()
            chose = steps.answers & (steps.n_seen > 1)
            if chose.any():
                n, choice = steps.n_seen[chose], (after if attend == "all" else before)[chose]
                first = np.cumsum(n) - n
                x = np.log(np.maximum(np.linalg.norm(steps.seen[np.repeat(chose, steps.n_seen)] - np.repeat(choice, n, 0), axis=1), NEAR))
                p = np.exp(-w * (x - np.repeat(np.minimum.reduceat(x, first), n)))
                p /= np.repeat(np.add.reduceat(p, first), n)
                mean = np.add.reduceat(p * x, first)
                total[3:6] += len(n), (mean - x[first + steps.answer[chose]]).sum(), (p * (x - np.repeat(mean, n)) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    joined = _with_starts(table, a, dims, attend, cut)
    out = np.zeros(6 + dims * dims)
    for r in joined.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def _spread(second: np.ndarray, rank: int) -> tuple[np.ndarray, float]:
    """The likeliest factors and noise of a covariance: its leading directions, and the mean of what is left."""
    values, vectors = np.linalg.eigh(second)
    values, vectors = np.maximum(values[::-1], 1e-9), vectors[:, ::-1]
    rank = min(rank, len(values) - 1)
    noise = float(values[rank:].mean())
    return vectors[:, :rank] * np.sqrt(np.maximum(values[:rank] - noise, 0)), noise


def fit(table: DataFrame, dims: int, rank: int = 0, attend: str = "chosen", prior: float = 1.0, tolerance: float = 1e-6, rounds: int = 100) -> Replies:
    """The model that explains best what the users of segments() answered and wrote.

    States begin at 0. With attend "chosen" a user chooses, then moves towards the comment
    answered; with "all" the user first moves towards the mean of those seen. In each
    round one pass over the steps gives the sums for a Gauss-Newton step of the attention, a
    Newton step of the weight (normal prior around 0) and the covariance of what is
    written. Steps without a choice, or with one comment seen, say nothing of the weight.
    An error is raised where the rounds do not settle.
    """
    model, cut = Replies(0.5, 0.0, prior, np.zeros((dims, 0)), 1.0), _are_cut(table)
    for _ in range(rounds):
        n, slope, bend, m, push, pull, *second = _expected(table, model, dims, attend, cut)
        factors, noise = _spread(np.reshape(second, (dims, dims)) / n, rank) if n else (model.factors, model.noise)
        a = float(np.clip(model.attention + np.clip(slope / bend if bend > 0 else 0.0, -0.2, 0.2), 1e-3, 1 - 1e-3))
        curve = pull + 1 / prior**2
        w = model.weight + float(np.clip((push - model.weight / prior**2) / curve, -1, 1))
        moved = max(abs(a - model.attention), abs(w - model.weight), abs(noise - model.noise))
        model = Replies(a, w, curve**-0.5, factors, noise)
        if moved < tolerance:
            return model
    raise RuntimeError(f"the fit has not settled after {rounds} rounds: it last moved by {moved:g}")


def states(table: DataFrame, model: Replies, dims: int, attend: str = "chosen") -> DataFrame:
    """(user, place, state) of each step of segments(), after it."""
    kind = dict(table.dtypes)["user"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            steps = _Steps(part, dims, attend)
            _, after, *_ = steps.walk(_vectors(part.column("s"), dims), _vectors(part.column("d"), dims), model.attention)
            user = part.column("user").take(pa.array(np.repeat(np.arange(part.num_rows), steps.length)))
            yield pa.RecordBatch.from_arrays([user, steps.place, _column(after)], ["user", "place", "state"])

    return _with_starts(table, model.attention, dims, attend, _are_cut(table)).mapInArrow(run, f"user {kind}, place long, state array<double>")
