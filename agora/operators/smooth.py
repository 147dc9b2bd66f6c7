"""Smooth opinions over time: a Gaussian process as a state that is filtered forward and smoothed backward."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.opinions import precisions
from agora.operators.ordered import numbered
from agora.sources.store import saved

#: (A, b, C, e, J): what a stretch of steps does to a state of any mean and variance before it.
Element = tuple[float, float, float, float, float]


def _forward(i: Element, j: Element) -> Element:
    """Two stretches as one, i before j."""
    d = 1 / (1 + i[2] * j[4])
    return (
        j[0] * d * i[0],
        j[0] * d * (i[1] + i[2] * j[3]) + j[1],
        j[0] * d * i[2] * j[0] + j[2],
        i[0] * d * (j[3] - j[4] * i[1]) + i[3],
        i[0] * d * j[4] * i[0] + i[4],
    )


def _backward(i: tuple, j: tuple) -> tuple:
    """(E, g, L) of two stretches as one, i before j."""
    return i[0] * j[0], i[0] * j[1] + i[1], i[0] * j[2] * i[0] + i[2]


def _element(gap: float | None, y: float, r: float, scale: float, length: float) -> Element:
    """One observation of noise variance r, a gap after the one before; None for a user's first."""
    f = 0.0 if gap is None else np.exp(-gap / length)
    q = scale * (1 - f * f)
    s = q + r
    k = q / s
    return (1 - k) * f, k * y, (1 - k) * q, f * y / s, f * f / s


def trajectories(obs: DataFrame, profile: DataFrame, keys: list[str], order: list[str], scale: float = 1.0, length: float = 7 * 86_400.0, noise: float = 0.25, steps: int = 512) -> DataFrame:
    """(keys, order, mean, var): the opinion behind each observation, given all of the key's.

    An opinion is a Gaussian process of mean 0 and covariance scale * e ** -(gap / length),
    `order` beginning with the time. A prediction of precision w, by the classifier's
    confusion table, observes it with variance noise / w; those of precision 0 or no value
    say nothing and go. That process is a state that forgets: a filter forward and a
    smoother backward give what a dense solve would, in time linear in the observations.

    A key's observations are cut into stretches by place. What a stretch does to any state
    is five numbers, so stretches are summed up alone, joined in order, and then filled
    in; so too backward. No task holds more than a stretch, or a short row for each, and
    only keys of several stretches are joined.
    """
    t = order[0]
    rows = obs.where("value is not null").join(F.broadcast(precisions(profile)), ["classifier_idx", "value"]).where("w > 0")  # nine rows for each classifier
    rows = numbered(rows.select(*keys, *order, F.col("value").cast("double").alias("_y"), (F.lit(noise) / F.col("w")).alias("_r")), keys, [F.col(c) for c in order])
    rows = rows.withColumn("_part", F.floor(F.col("place") / steps)).withColumn("_parts", F.ceil(F.col("place_of") / steps))
    step = F.struct("place", F.col(t).cast("double").alias("t"), F.col("_y").alias("y"), F.col("_r").alias("r"), F.struct(*order).alias("o"))
    every = saved(rows.groupBy(*keys, "_part", "_parts").agg(F.array_sort(F.collect_list(step)).alias("s")), "observed")
    # A key of one stretch has nothing before or after it, so it takes part in no join.
    alone, parts = every.where("_parts = 1").drop("_parts"), every.where("_parts > 1").drop("_parts")
    cut = parts.limit(1).count() > 0
    # The time before a stretch is that of the last row of the one before.
    ends = parts.select(*keys, (F.col("_part") + 1).alias("_part"), F.element_at("s", -1)["t"].alias("_before"))
    if cut:
        parts = saved(_same(parts, ends, [*keys, "_part"], "left"), "stretches")

    def elements(s, before: float | None) -> list[Element]:
        times = [before if before == before else None, *[x["t"] for x in s]]
        return [_element(None if a is None else b - a, x["y"], x["r"], scale, length) for a, b, x in zip(times, times[1:], s, strict=False)]

    def carried(name: str, sizes: int, of: Callable, join: Callable, later: bool) -> DataFrame:
        """The numbers of all stretches of a key before each (or after it), joined."""
        schema = ", ".join(f"{k} {dict(parts.dtypes)[k]}" for k in keys) + ", _part long, e array<double>"

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                yield part[[*keys, "_part"]].assign(e=[list(of(r)) for r in part.to_dict("records")])

        def along(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("_part", ascending=not later)
            now, out = None, []
            for e in part["e"]:
                out.append(None if now is None else list(now))
                now = tuple(e) if now is None else join(tuple(e), now) if later else join(now, tuple(e))
            return part[[*keys, "_part"]].assign(e=out)

        table = source.mapInPandas(alone, schema)
        return table.groupBy(*keys).applyInPandas(along, schema).withColumnRenamed("e", name)

    def states(r) -> tuple[list, list]:
        """The filtered mean and variance of each step, and its part in the smoother but for the key's last step."""
        now = tuple(r["_ahead"]) if r["_ahead"] is not None else None
        out = []
        for e in elements(r["s"], r["_before"]):
            now = e if now is None else _forward(now, e)
            out.append((now[1], now[2]))
        times = [x["t"] for x in r["s"]] + ([r["_after"]] if r["_after"] == r["_after"] and r["_after"] is not None else [])
        back = []
        for (m, p), a, b in zip(out, times, [*times[1:], None], strict=False):
            f = 0.0 if b is None else np.exp(-(b - a) / length)
            gain = p * f / (f * f * p + scale * (1 - f * f))
            back.append((gain, m - gain * f * m, p - gain * f * p))
        return out, back

    none = {"_before": "double", "_ahead": "array<double>", "_after": "double", "_behind": "array<double>"}
    whole = alone.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    if cut:
        source = parts
        ahead = carried("_ahead", 5, lambda r: reduce(_forward, elements(r["s"], r["_before"])), _forward, later=False)
        filtered = saved(_same(parts, ahead, [*keys, "_part"], "left"), "ahead")
        begins = parts.select(*keys, (F.col("_part") - 1).alias("_part"), F.col("s")[0]["t"].alias("_after"))
        source = saved(_same(filtered, begins, [*keys, "_part"], "left"), "filtered")
        behind = carried("_behind", 3, lambda r: reduce(_backward, states(r)[1]), _backward, later=True)
        whole = whole.unionByName(_same(source, behind, [*keys, "_part"], "left"))

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.to_dict("records"):
                now = tuple(r["_behind"]) if r["_behind"] is not None else None
                for x, e in zip(reversed(list(r["s"])), reversed(states(r)[1]), strict=True):
                    now = e if now is None else _backward(e, now)
                    rows.append((*[r[k] for k in keys], *[x["o"][c] for c in order], now[1], now[2]))
            yield pd.DataFrame(rows, columns=[*keys, *order, "mean", "var"])

    kinds = dict(rows.dtypes)
    return whole.mapInPandas(filled, ", ".join(f"{c} {kinds[c]}" for c in [*keys, *order]) + ", mean double, var double")


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join in which null keys are keys."""
    same = F.lit(True)
    for k in on:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return left.alias("a").join(right.alias("b"), same, how).select("a.*", *[F.col(f"b.{c}") for c in right.columns if c not in on])
