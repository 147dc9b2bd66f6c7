"""Opinions by sampling their posterior: many short chains, one set for each user and issue."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.inference import STATES, row_normalized
from agora.sources.store import saved


#: Keys that are sampled side by side, about.
GROUP = 256


def chains(counts: np.ndarray, emission: np.ndarray, rnd: np.random.Generator, number: int, draws: int, warm: int, prior: float) -> np.ndarray:
    """Shares of the three stances (keys x chains x draws x 3) given how often each prediction was made.

    counts (keys x kinds) has a number for each kind of prediction, emission (keys x kinds x 3)
    its probability from each stance. A sweep draws how many predictions of each kind come
    from each stance, then the shares, for all keys at once. Chains begin at draws of the
    prior. A kind that a key lacks has a count of 0, and one that a single stance can make
    needs no draw.
    """
    sure = (emission > 0).sum(2) == 1
    base = np.einsum("kc,kcs->ks", np.where(sure, counts, 0), (emission > 0).astype(np.int64))[:, None]
    left = np.argsort(sure, 1, kind="stable")[:, : (~sure).sum(1).max(initial=0)]
    counts, emission = np.take_along_axis(np.where(sure, 0, counts), left, 1), np.take_along_axis(emission, left[:, :, None], 1)
    shares = rnd.dirichlet([prior] * 3, (len(counts), number))
    out = np.empty((len(counts), number, draws, 3))
    for sweep in range(warm + draws):
        p = shares[:, :, None, :] * emission[:, None]
        p /= (p[..., 0] + p[..., 1] + p[..., 2])[..., None]
        hidden = base + rnd.multinomial(counts[:, None], p).sum(2)
        gamma = rnd.standard_gamma(hidden + prior)
        shares = np.maximum(gamma / gamma.sum(2, keepdims=True), 1e-12)
        if sweep >= warm:
            out[:, :, sweep - warm] = shares
    return out


def mixing(x: np.ndarray) -> np.ndarray:
    """The potential scale reduction of chains x draws (and of each, where more axes come before), each chain cut in two: near 1 where they agree."""
    half = x.shape[-1] // 2
    x = np.concatenate([x[..., :half], x[..., half : 2 * half]], -2)
    within, between = x.var(-1, ddof=1).mean(-1), x.mean(-1).var(-1, ddof=1)
    some = within > 0
    return np.where(some, np.sqrt((half - 1) / half + between / np.where(some, within, 1.0)), 1.0)


def sampled_opinions(obs: DataFrame, profile: DataFrame, keys: list[str], number: int = 4, draws: int = 250, warm: int = 50, prior: float = 1.0, seed: int = 0) -> DataFrame:
    """(keys, n, mean, sd, p_against, p_neutral, p_favor, error, mixing) of the posterior of each key's opinion.

    A key's observations count by classifier and prediction, with partial sums, so a key of
    any size is at most three rows for each classifier. Keys are dealt by hash into groups
    of about GROUP, which draw side by side, in order of their hashes, from a generator
    keyed by the group, so a result depends on neither partitions nor retries.
    mean is that of the stance (-1, 0, 1); error is the standard error of that mean by the
    spread of the chains' means. Null predictions go.
    """
    p = row_normalized(profile).groupBy("classifier_idx", F.col("pred_value").alias("value")).agg(*[F.max(F.when(F.col("true_value") == s, F.col("p"))).alias(f"e{i}") for i, s in enumerate(STATES)])
    cells = obs.where("value is not null").groupBy(*keys, "classifier_idx", "value").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(p), ["classifier_idx", "value"])  # nine rows for each classifier
    cell = F.struct("classifier_idx", "value", "n", "e0", "e1", "e2")
    rows = saved(cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.sum("n").alias("n")).withColumn("seed", F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys])), "cells")
    groups = max(1, -(-rows.count() // GROUP))
    # The rows are few bytes but much work, so tasks go by groups: a number that is asked for is not merged by size.
    rows = rows.withColumn("bunch", F.pmod(F.col("seed"), F.lit(groups))).repartition(-(-groups // 4), "bunch")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seed", *keys], kind="stable", ignore_index=True)
        found = []
        for at in range(0, len(part), 4 * GROUP):  # a bound for the draws that are held
            some = part[at : at + 4 * GROUP]
            counts = np.zeros((len(some), max(map(len, some["cells"]))), np.int64)
            emission = np.ones((*counts.shape, 3))
            for i, cells in enumerate(some["cells"]):
                for j, c in enumerate(cells):
                    counts[i, j], emission[i, j] = c["n"], (c["e0"], c["e1"], c["e2"])
            rnd = np.random.Generator(np.random.Philox(key=[int(some["bunch"].iloc[0]), (seed + at) & (2**64 - 1)]))
            x = chains(counts, emission, rnd, number, draws, warm, prior)
            stance = x @ np.array(STATES, float)
            error = stance.mean(2).std(1, ddof=1) / number**0.5 if number > 1 else np.full(len(some), np.nan)
            found.append(np.column_stack([stance.mean((1, 2)), stance.std((1, 2)), x.mean((1, 2)), error, mixing(stance)]))
        columns = ["mean", "sd", "p_against", "p_neutral", "p_favor", "error", "mixing"]
        return pd.concat([part[[*keys, "n"]], pd.DataFrame(np.concatenate(found), columns=columns)], axis=1)

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.groupBy("bunch").applyInPandas(run, f"{kinds}, n long, mean double, sd double, p_against double, p_neutral double, p_favor double, error double, mixing double")
