"""Opinions inferred through classifier confusion: sums in Spark, small solvers on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.sources import store

STATES = (-1, 0, 1)


def row_normalized(profile: DataFrame) -> DataFrame:
    """P(predicted | true), a third each where a true label has no rows."""
    whole = F.sum("n").over(Window.partitionBy("classifier_idx", "true_value"))
    return profile.withColumn("p", F.coalesce(F.try_divide(F.col("n").cast("double"), whole), F.lit(1 / 3)))


def column_normalized(profile: DataFrame) -> DataFrame:
    """P(true | predicted), a third each where a predicted label has no rows."""
    whole = F.sum("n").over(Window.partitionBy("classifier_idx", "pred_value"))
    return profile.withColumn("q", F.coalesce(F.try_divide(F.col("n").cast("double"), whole), F.lit(1 / 3)))


def posterior(obs: DataFrame, profile: DataFrame) -> DataFrame:
    """Observations with q_against, q_neutral and q_favor."""
    q = column_normalized(profile)
    named = {-1: "q_against", 0: "q_neutral", 1: "q_favor"}
    wide = q.groupBy("classifier_idx", F.col("pred_value").alias("value")).agg(*[F.max(F.when(F.col("true_value") == k, F.col("q"))).alias(n) for k, n in named.items()])
    return obs.where("value is not null").join(wide, ["classifier_idx", "value"])


def categorical(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most likely shares of the three stances: means of the posteriors."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c.replace("q_", "p_")) for c in ("q_against", "q_neutral", "q_favor")])


def normal_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, mu and the sum of squares s around mu."""
    first, second = F.col("q_favor") - F.col("q_against"), F.col("q_favor") + F.col("q_against")
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("a"), F.sum(second).alias("b"))
    mu = F.col("a") / F.col("n")
    return sums.select(*keys, "n", mu.alias("mu"), F.greatest(F.col("b") - F.col("n") * mu * mu, F.lit(0.0)).alias("s"))


def log_scale(n: np.ndarray, s: np.ndarray, location: float = 0.1, scale: float = 0.2) -> np.ndarray:
    """The root in log sigma of -n - 1 + s e**(-2 x) - (x - location) / scale**2, which falls in x."""
    low, high = np.full(len(n), -20.0), np.full(len(n), 20.0)
    for _ in range(80):
        mid = (low + high) / 2
        up = -n - 1 + s * np.exp(-2 * mid) - (mid - location) / scale**2 > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def normal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """mu and the scale sigma of a normal with a log-normal prior on the scale."""
    stats = normal_statistics(rows, keys)

    @F.pandas_udf("double")
    def sigma(n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(np.exp(log_scale(n.to_numpy(float), s.to_numpy(float))))

    return stats.select(*keys, "n", "mu", sigma(F.col("n").cast("double"), "s").alias("sigma"))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    while (low := x < 6).any():
        shift = np.where(low, shift - 1 / x, shift)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    while (low := x < 6).any():
        shift = np.where(low, shift + 1 / (x * x), shift)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return shift + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r / 42))


def beta_roots(n: np.ndarray, up: np.ndarray, down: np.ndarray, location: float = 2.0, scale: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Most likely alpha and beta of sums of log z and log (1 - z), with log-normal priors: damped Newton in their logs."""
    x = np.full((2, len(n)), location)
    sums = np.stack([up, down])
    for _ in range(100):
        ab = np.exp(x)
        whole = ab.sum(0)
        slope = ab * (sums - n * (digamma(ab) - digamma(whole))) - (x - location) / scale**2 - 1
        bend = -ab * ab * n * trigamma(ab) + ab * (sums - n * (digamma(ab) - digamma(whole))) - 1 / scale**2
        cross = ab[0] * ab[1] * n * trigamma(whole)
        own = bend + ab * ab * n * trigamma(whole)
        own = np.minimum(own, -1e-6)
        det = own[0] * own[1] - cross * cross
        det = np.where(det > 1e-9, det, own[0] * own[1])
        step = np.stack([(own[1] * slope[0] - cross * slope[1]) / det, (own[0] * slope[1] - cross * slope[0]) / det])
        x = x - np.clip(step, -0.5, 0.5)
    return np.exp(x[0]), np.exp(x[1])


def beta(rows: DataFrame, keys: list[str], edge: float = 1e-6) -> DataFrame:
    """alpha and beta for z of edge, a half and 1 - edge in place of the three stances."""
    import math

    a, h, b = math.log(edge), math.log(0.5), math.log(1 - edge)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(a * F.col("q_against") + h * F.col("q_neutral") + b * F.col("q_favor")).alias("up"),
        F.sum(b * F.col("q_against") + h * F.col("q_neutral") + a * F.col("q_favor")).alias("down"),
    )

    @F.pandas_udf("alpha double, beta double")
    def solve(n: pd.Series, up: pd.Series, down: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("alpha", "beta"), beta_roots(*(s.to_numpy(float) for s in (n, up, down))), strict=True)))

    return stats.withColumn("r", solve("n", "up", "down")).select(*keys, "n", "r.alpha", "r.beta")


#: Prior counts of the first state and of moves between states.
START_PRIOR, MOVE_PRIOR = np.array([1.0, 10.0, 1.0]), 0.9 * np.eye(3) + 0.1


def expected_moves(seq: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward over sequences of one length (sequences x steps x 3 emissions): summed expected first states, moves, log likelihood."""
    count, n, _ = seq.shape
    f, b, scale = np.zeros((n, count, 3)), np.ones((count, 3)), np.zeros((n, count, 1))
    state = start * seq[:, 0]
    for i in range(n):
        if i:
            state = f[i - 1] @ moves * seq[:, i]
        scale[i] = np.maximum(state.sum(1, keepdims=True), 1e-300)
        f[i] = state / scale[i]
    pairs = np.zeros((3, 3))
    for i in range(n - 1, 0, -1):
        ahead = seq[:, i] * b / scale[i]
        pairs += f[i - 1].T @ ahead * moves
        b = ahead @ moves.T
    return (f[0] * b).sum(0), pairs, float(np.log(scale).sum())


def hidden_markov(obs: DataFrame, profile: DataFrame, group: str, user: str = "user_id", order: tuple[str, ...] = ("t", "comment_id"), rounds: int = 200, tolerance: float = 1e-3) -> DataFrame:
    """(group, from, to, p): moves between hidden stances of each group, seen through classifiers.

    Expectation runs in Spark, over batches of sequences of one length; what reaches the
    driver in a round is nine sums and three for each group. Rounds end when no move
    changes by `tolerance` or more; after `rounds` of them it raises. A tolerance of
    0 asks for just that many rounds. Prior counts below 1 are clipped at 0. A user's
    sequence is one row, so it should fit a task.
    """
    emission = row_normalized(profile).groupBy("classifier_idx", F.col("pred_value").alias("value")).agg(F.array_sort(F.collect_list(F.struct("true_value", "p"))).alias("e"))
    rows = obs.where("value is not null").join(emission, ["classifier_idx", "value"]).select(group, user, F.struct(*order, F.transform("e", lambda x: x["p"]).alias("e")).alias("s"))
    sequences = rows.groupBy(group, user).agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["e"])).alias("seq")).where(F.size("seq") > 3)
    sequences = store.saved(sequences.select(F.col(group).cast("string").alias("g"), F.size("seq").alias("n"), "seq").sortWithinPartitions("g", "n"), "sequences")
    groups = sorted(r["g"] for r in sequences.select("g").distinct().collect())
    model = {g: (np.full(3, 1 / 3), MOVE_PRIOR / MOVE_PRIOR.sum(1, keepdims=True)) for g in groups}
    schema = "g string, i int, j int, x double"
    for _ in range(rounds):
        now = dict(model)

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sums: dict[str, np.ndarray] = {}
                for (g, n), part in batch.groupby(["g", "n"]):
                    first, pairs, _ = expected_moves(np.stack(part["seq"].to_numpy()).reshape(len(part), n // 3, 3), *now[g])
                    sums[g] = sums.get(g, np.zeros((4, 3))) + np.vstack([first, pairs])
                yield pd.DataFrame([(g, i, j, m[i, j]) for g, m in sums.items() for i in range(4) for j in range(3)], columns=["g", "i", "j", "x"])

        total: dict[str, np.ndarray] = {g: np.zeros((4, 3)) for g in groups}
        for r in sequences.mapInPandas(expect, schema).groupBy("g", "i", "j").agg(F.sum("x").alias("x")).collect():
            total[r["g"]][r["i"], r["j"]] = r["x"]
        changed = 0.0
        for g, m in total.items():
            start = np.maximum(m[0] + START_PRIOR - 1, 0)
            moves = np.maximum(m[1:] + MOVE_PRIOR - 1, 0)
            # A stance that nobody is likely to leave says nothing of where to; its row stays.
            moves = np.where(moves.sum(1, keepdims=True) > 0, moves, model[g][1])
            moves = moves / moves.sum(1, keepdims=True)
            changed = max(changed, float(np.abs(moves - model[g][1]).max()))
            model[g] = (start / max(start.sum(), 1e-300), moves)
        if changed < tolerance:
            break
    else:
        if tolerance:
            raise RuntimeError(f"the moves have not settled after {rounds} rounds: one last changed by {changed:g}")
    spark = obs.sparkSession
    return spark.createDataFrame([(g, STATES[i], STATES[j], float(model[g][1][i, j])) for g in groups for i in range(3) for j in range(3)], f"{group} string, `from` int, `to` int, p double")


def movement_index(moves: DataFrame, keys: list[str]) -> DataFrame:
    """The Frobenius norm of the moves less the identity."""
    d = F.col("p") - F.when(F.col("from") == F.col("to"), 1.0).otherwise(0.0)
    return moves.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("movement"))
