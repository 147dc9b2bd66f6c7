"""Correlation, density and polarization of the opinions of users.

Rows are (user_id, issue, mean, var).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from agora.functions import draws
from agora.sources import store
from agora.sources.store import saved


def issue_pairs(rows: DataFrame, without_zero: bool = False) -> DataFrame:
    """(user_id, i, j, x, y, vx, vy) for issues i < j on which a user has a mean."""
    rows = rows.where(F.col("mean").isNotNull())
    if without_zero:
        rows = rows.where(F.col("mean") != 0)
    a = rows.select("user_id", F.col("issue").alias("i"), F.col("mean").alias("x"), F.col("var").alias("vx"))
    b = rows.select("user_id", F.col("issue").alias("j"), F.col("mean").alias("y"), F.col("var").alias("vy"))
    return a.join(b, "user_id").where("i < j")


def _sums(w: Column, x: Column, y: Column) -> list[Column]:
    return [F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"), F.count(F.lit(1)).alias("n")]


def least_squares(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Slope, intercept, R2 and t of y on x, weighted by 1 / max((vx + vy) / 2, 0.01); rows without a variance go."""
    w = 1 / F.greatest((F.col("vx") + F.col("vy")) / 2, F.lit(0.01))
    rows = pairs.where("vx is not null and vy is not null").groupBy(*keys).agg(*_sums(w, F.col("x"), F.col("y")))
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    slope = F.try_divide(cxy, cxx)
    rows = rows.withColumn("slope", slope).withColumn("r2", F.try_divide(cxy * cxy, cxx * cyy))
    t = F.sign(F.col("slope")) * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    return rows.select(*keys, "n", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"), "r2", t.alias("t"))


def weighted_pearson(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation with weights e ** -(vx + vy)."""
    w = F.exp(-(F.col("vx") + F.col("vy")))
    rows = pairs.where("vx is not null and vy is not null").groupBy(*keys).agg(*_sums(w, F.col("x"), F.col("y")))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    both = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw"))
    return rows.select(*keys, "n", F.when(both > 0, F.try_divide(cov, F.sqrt(F.greatest(both, F.lit(0.0))))).alias("r"))


def correlation_timeline(pairs: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Plain correlation in each window with enough users, within [-1, 1]."""
    rows = pairs.groupBy(*keys).agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(~F.isnan("r"), F.col("r")))))


def window_means(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Mean over users weighted by e ** -var."""
    w = F.exp(-F.col("var"))
    out = rows.where("var is not null").groupBy(*keys).agg(F.try_divide(F.sum(w * F.col("mean")), F.sum(w)).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least)


def grid(spark: SparkSession, n: int) -> DataFrame:
    """(g, x): n points from -1 to 1."""
    return spark.range(n).select(F.col("id").alias("g"), (F.col("id") * (2.0 / (n - 1)) - 1.0).alias("x"))


def _density(x: Column, mean: Column, var: Column) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * var)) / F.sqrt(2 * math.pi * var)


def mixture_1d(rows: DataFrame, keys: list[str], points: int = 25) -> DataFrame:
    """Density of users' means on a grid: a Gaussian each, of weight 1; a point where the variance is 0.

    The grid is an array made of `points` numbers, so users meet it without a join.
    """
    rows = rows.where("mean is not null and var is not null").withColumn("ps", _share_curve("mean", "var", points))
    total = F.aggregate("ps", F.lit(0.0), lambda s, p: s + p)
    rows = rows.withColumn("total", total).where("total > 0").select(*keys, "total", F.posexplode("ps").alias("g", "p"))
    sums = rows.groupBy(*keys, "g").agg(F.sum(F.col("p") / F.col("total")).alias("p"))
    whole = F.sum("p").over(Window.partitionBy(*keys))
    return sums.select(*keys, F.col("g").cast("long").alias("g"), (F.col("p") / whole).alias("p"))


def _share_curve(mean: str, var: str, points: int) -> Column:
    """A user's density on the grid, normalised over it: a Gaussian, or all at the nearest point."""
    xs = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda g: g * (2.0 / (points - 1)) - 1.0)
    nearest = F.least(F.greatest(F.ceil((F.col(mean) + 1) * ((points - 1) / 2.0) - 0.5), F.lit(0)), F.lit(points - 1))
    point = F.transform(xs, lambda x, g: F.when(g == nearest, 1.0).otherwise(0.0))
    curve = F.transform(xs, lambda x: _density(x, F.col(mean), F.greatest(F.col(var), F.lit(1e-300))))
    return F.when(F.col(var) <= 1e-9, point).otherwise(curve)


def mixture_2d(pairs: DataFrame, keys: list[str], points: int = 25) -> DataFrame:
    """The same over two issues; users with exactly one variance of 0 are left out.

    A user's density is a product of two curves, so only the curves are computed for a
    user, and cells are products of their entries.
    """
    rows = pairs.where("vx is not null and vy is not null").where("(vx <= 1e-9) = (vy <= 1e-9)")
    rows = rows.select(*keys, _share_curve("x", "vx", points).alias("px"), _share_curve("y", "vy", points).alias("py"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, p: s + p)
    rows = rows.withColumn("total", total("px") * total("py")).where("total > 0")
    cells = rows.select(*keys, "total", "py", F.posexplode("px").alias("gx", "a")).select(*keys, "total", "gx", "a", F.posexplode("py").alias("gy", "b"))
    sums = cells.groupBy(*keys, "gx", "gy").agg(F.sum(F.col("a") * F.col("b") / F.col("total")).alias("p"))
    whole = F.sum("p").over(Window.partitionBy(*keys))
    return sums.select(*keys, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), (F.col("p") / whole).alias("p"))


def beta_mixture(rows: DataFrame, keys: list[str], points: int = 25) -> DataFrame:
    """Density of users' beliefs on a grid inside (0, 1): a beta(alpha, beta) each, normalised over the grid.

    The beta function cancels in that, so a power of x and one of 1 - x are all it takes;
    logarithms are shifted by their largest, which keeps narrow densities in range.
    """
    xs = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda g: (g + 0.5) / points)
    logs = F.transform(xs, lambda x: (F.col("alpha") - 1) * F.log(x) + (F.col("beta") - 1) * F.log(1 - x))
    rows = rows.withColumn("logs", logs)
    rows = rows.withColumn("ps", F.transform("logs", lambda v: F.exp(v - F.array_max("logs"))))
    rows = rows.withColumn("total", F.aggregate("ps", F.lit(0.0), lambda s, p: s + p)).select(*keys, "total", F.posexplode("ps").alias("g", "p"))
    sums = rows.groupBy(*keys, "g").agg(F.sum(F.col("p") / F.col("total")).alias("p"))
    whole = F.sum("p").over(Window.partitionBy(*keys))
    return sums.select(*keys, F.col("g").cast("long").alias("g"), (F.col("p") / whole).alias("p"))


def mean_products(rows: DataFrame, shares: list[str]) -> DataFrame:
    """For issues i < j, the mean over users of the products of their shares: (i, j, a, b, p)."""
    left = rows.select("user_id", F.col("issue").alias("i"), F.posexplode(F.array(*shares)).alias("a", "x"))
    right = rows.select("user_id", F.col("issue").alias("j"), F.posexplode(F.array(*shares)).alias("b", "y"))
    both = left.join(right, "user_id").where("i < j")
    return both.groupBy("i", "j", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.avg(F.col("x") * F.col("y")).alias("p"))


def beliefs(rows: DataFrame) -> DataFrame:
    """(user_id, issue, b): means from [-1, 1] to [0, 1], a missing one in the middle."""
    return rows.select("user_id", "issue", (0.5 * (F.coalesce("mean", F.lit(0.0)) + 1)).alias("b"))


def symmetric_polarization(rows: DataFrame) -> DataFrame:
    """Sum over issues of the mean distance from the mean, halved."""
    means = rows.groupBy("issue").agg(F.avg("b").alias("_mean"))
    by_issue = rows.join(means, "issue").withColumn("d", F.abs(F.col("b") - F.col("_mean"))).groupBy("issue").agg((F.sum("d") / (2 * F.count("d"))).alias("p"))
    return by_issue.agg(F.sum("p").alias("polarization"))


def two_blocks(issues: list) -> list[list]:
    """The second block of every partition of the issues into two; the first issue is in the other."""
    rest = issues[1:]
    return [list(c) for k in range(1, len(rest) + 1) for c in combinations(rest, k)]


def asymmetric_polarization(rows: DataFrame, issues: list) -> DataFrame:
    """For each two-block partition, the largest split of users by the block's mean belief.

    With users in order of belief y, a split after i of n has i * (sum above) - (n - i) *
    (sum below), over 4 n**2. Users of one belief are one row; rows are dealt over ranges
    of (partition, belief), and what the ranges before hold is added from one row for each
    partition and range, so no task orders a partition. Partitions double with each issue.
    """
    spark = rows.sparkSession
    if len(issues) > 16:
        raise ValueError("partitions double with each issue: choose at most 16, or merge some first")
    blocks = [(k, issue) for k, block in enumerate(two_blocks(issues)) for issue in block]
    kind = dict(rows.dtypes)["issue"]
    parts = spark.createDataFrame(blocks, f"part int, issue {kind}")
    y = rows.join(F.broadcast(parts), "issue").groupBy("part", "user_id").agg(F.avg("b").alias("y"))
    y = y.groupBy("part", "y").agg(F.count(F.lit(1)).alias("k"))
    y = y.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "y").withColumn("_range", F.spark_partition_id())
    y = store.saved(y, "beliefs")
    sums = [F.sum("k").alias("rk"), F.sum(F.col("k") * F.col("y")).alias("ry")]
    ranges = y.groupBy("part", "_range").agg(*sums)
    own, upto = Window.partitionBy("part"), Window.partitionBy("part").orderBy("_range")
    before = [(F.sum(c).over(upto) - F.col(c)).alias(f"before_{c}") for c in ("rk", "ry")]
    ranges = ranges.select("part", "_range", *before, *[F.sum(c).over(own).alias(f"all_{c}") for c in ("rk", "ry")])
    order = Window.partitionBy("part", "_range").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumn("i", F.sum("k").over(order)).withColumn("low", F.sum(F.col("k") * F.col("y")).over(order))
    y = y.join(ranges, ["part", "_range"])
    i, low, n = F.col("before_rk") + F.col("i"), F.col("before_ry") + F.col("low"), F.col("all_rk")
    # Within users of one belief the value is linear in i, so its largest is at an end.
    value = (i * (F.col("all_ry") - low) - (n - i) * low) / (4.0 * n * n)
    return y.groupBy("part").agg(F.max(value).alias("polarization"))


def belief_bins(rows: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Shares of beliefs in n bins."""
    bin_ = F.least(F.floor(F.col("b") * n), F.lit(n - 1)).cast("long")
    counts = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("p"))


def esteban_ray(bins: DataFrame, keys: list[str], n: int = 10, alpha: float = 1.6) -> DataFrame:
    """Sum over bins of p_i ** (1 + alpha) p_j |x_i - x_j|; each key has at most n bins."""
    own = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "p")).alias("bs"))
    total = F.aggregate("bs", F.lit(0.0), lambda s, a: s + F.aggregate("bs", F.lit(0.0), lambda t, b: t + F.pow(a["p"], F.lit(1 + alpha)) * b["p"] * F.abs(a["bin"] - b["bin"]) / n))
    return own.select(*keys, total.alias("polarization"))


def movement_range(line: DataFrame) -> DataFrame:
    """(user_id, issue, range): largest less smallest mean over windows."""
    return line.where("mean is not null").groupBy("user_id", "issue").agg((F.max("mean") - F.min("mean")).alias("range"), F.count(F.lit(1)).alias("windows"))


def farthest_windows(line: DataFrame) -> DataFrame:
    """The largest distance of a user between two windows, over the issues that both have."""
    cells = line.where("mean is not null").select("user_id", "issue", "window_id", "mean")
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.issue") == F.col("b.issue")) & (F.col("a.window_id") < F.col("b.window_id")))
    d = F.pow(F.col("a.mean") - F.col("b.mean"), F.lit(2.0))
    far = pairs.groupBy(F.col("a.user_id").alias("user_id"), F.col("a.window_id").alias("w1"), F.col("b.window_id").alias("w2")).agg(F.sqrt(F.sum(d)).alias("d"))
    return far.groupBy("user_id").agg(F.max("d").alias("distance"))


@dataclass(frozen=True)
class Statistic:
    """A number of a group that follows from sums over its rows: what each row adds, and the number from the sums."""

    terms: Callable[[], list[Column]]
    value: Callable[[list[Column]], Column]


def _correlation(t: list[Column]) -> Column:
    n, x, y, xx, yy, xy = t
    both = F.greatest(xx * n - x * x, F.lit(0.0)) * F.greatest(yy * n - y * y, F.lit(0.0))
    return F.try_divide(xy * n - x * y, F.sqrt(both))


#: Pearson's correlation of x and y, and the mean of `mean` weighted by e ** -var.
CORRELATION = Statistic(lambda: [F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("x") * F.col("y")], _correlation)
WEIGHTED_MEAN = Statistic(lambda: [F.exp(-F.col("var")), F.exp(-F.col("var")) * F.col("mean")], lambda t: F.try_divide(t[1], t[0]))


def bootstrap(rows: DataFrame, keys: list[str], unit: list[str], statistic: Statistic, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(keys, n, estimate, low, high): bias-corrected and accelerated intervals of a statistic of each group.

    Each row is drawn Poisson(1) times in each replicate, by a hash of its `unit` columns and
    the replicate. Rows of a unit share their draws, which are made once for all of a unit's
    rows in a batch; a product of draws and terms gives the sums of all replicates.

    The bias is the share of replicates below the estimate (half of those equal); the
    acceleration is the skew of the values without one row each, which follow from the
    group's sums less the row's own terms. An interval is null where all replicates are on
    one side. A group's list has as many values as there are replicates.
    """
    count = len(statistic.terms())
    names = [f"_t{k}" for k in range(count)]
    rows = saved(rows.select(*keys, *[u for u in unit if u not in keys], *[t.cast("double").alias(x) for t, x in zip(statistic.terms(), names, strict=True)]), "terms")
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"_s{k}") for k, x in enumerate(names)])
    sums = [F.col(f"_s{k}") for k in range(count)]
    whole = saved(whole.withColumn("estimate", statistic.value(sums)), "whole")

    without = F.col("_v") - F.col("estimate")
    left = rows.join(whole, keys).withColumn("_v", statistic.value([s - F.col(x) for s, x in zip(sums, names, strict=True)]))
    left = left.groupBy(*keys).agg(F.count("_v").alias("_m"), *[F.sum(F.pow(without, F.lit(p))).alias(f"_d{p}") for p in (1, 2, 3)])
    m, mean = F.col("_m"), F.try_divide(F.col("_d1"), F.col("_m"))
    second = F.col("_d2") - m * mean * mean
    third = F.col("_d3") - 3 * mean * F.col("_d2") + 2 * m * mean * mean * mean
    skew = F.coalesce(F.when(second > 1e-24, -third / (6 * F.pow(F.greatest(second, F.lit(1e-24)), F.lit(1.5)))), F.lit(0.0))

    drawn = _resampled(rows, keys, unit, names, replicates, seed)
    values = drawn.select(*keys, statistic.value(sums).alias("_r")).where("_r is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_values"))

    # Equal to nine digits is equal: sums in another order differ beyond.
    est = F.round("estimate", 9)
    below = F.size(F.filter("_values", lambda r: F.round(r, 9) < est)) + F.size(F.filter("_values", lambda r: F.round(r, 9) == est)) / 2
    found = whole.join(left.select(*keys, skew.alias("_skew")), keys).join(values, keys, "left")
    found = found.withColumn("_cuts", _accelerated(level)(F.try_divide(below, F.size("_values")), F.col("_skew")))
    low, high = (_quantile(F.col("_values"), F.col("_cuts")[k]) for k in (0, 1))
    return found.select(*keys, "n", "estimate", low.alias("low"), high.alias("high"))


def _resampled(rows: DataFrame, keys: list[str], unit: list[str], names: list[str], replicates: int, seed: int, most: int = 512) -> DataFrame:
    """(keys, replicate, _s0, _s1, ...): sums of the terms of each replicate's rows; replicates that draw no row of a key have none.

    A task keeps sums of at most `most` keys, so it sends a row for each key and replicate
    that it met, or more where it meets many keys.
    """
    steps = np.array(draws.poisson_steps())
    suffix = F.concat(*[F.coalesce(F.concat(F.lit(":"), F.col(u).cast("string")), F.lit("")) for u in unit])
    kinds = dict(rows.dtypes)
    own = [f"_k{i}" for i in range(len(keys))]
    table = rows.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], suffix.alias("_u"), *names).repartition("_u").sortWithinPartitions("_u")
    head = [f"{seed}:{k}".encode() for k in range(1, replicates + 1)]

    def told(sums: dict) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(sums), 16):
            some = list(sums.items())[at : at + 16]
            found = [(k, np.flatnonzero(total[:, -1]), total) for k, total in some]
            sizes = np.array([len(i) for _, i, _ in found])
            each = np.repeat(np.arange(len(found)), sizes)
            columns = [pa.array([k[c] for k, _, _ in found], type=schema.field(c).type).take(pa.array(each)) for c in range(len(keys))]
            columns.append(pa.array(np.concatenate([i for _, i, _ in found]) + 1, pa.int32()))
            columns += [pa.array(np.concatenate([t[i, c] for _, i, t in found])) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                units = part.column("_u").dictionary_encode()
                raw = np.array([[int.from_bytes(hashlib.md5(h + u).digest()[:4], "big") for h in head] for u in (x.encode() for x in units.dictionary.to_pylist())], float)
                drawn = np.searchsorted(steps, raw / 2.0**32, "left").astype(float)[units.indices.to_numpy()]
                # A null adds nothing to a sum; the last column tells whether a replicate has a row at all.
                terms = np.stack([part.column(n).fill_null(0.0).to_numpy(zero_copy_only=False) for n in names] + [np.ones(part.num_rows)], 1)
                groups: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(*[part.column(o).to_pylist() for o in own], strict=True)):
                    groups.setdefault(k, []).append(i)
                for k, where in groups.items():
                    more = drawn[where].T @ terms[where]
                    sums[k] = sums[k] + more if k in sums else more
                if len(sums) > most:
                    yield from told(sums)
                    sums = {}
        yield from told(sums)

    out = ", ".join([*[f"{o} {kinds[k]}" for k, o in zip(keys, own, strict=True)], "replicate int", *[f"{n} double" for n in names]])
    schema = to_arrow_schema(StructType.fromDDL(out))
    parts = table.mapInArrow(run, out).groupBy(*own, "replicate").agg(*[F.sum(n).alias(f"_s{i}") for i, n in enumerate(names)])
    return parts.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def _accelerated(level: float):
    """Of a share below and an acceleration: the two shares at which the replicates are cut."""

    def cuts(share: pd.Series, skew: pd.Series) -> pd.Series:
        z = NormalDist()
        ends = (z.inv_cdf((1 - level) / 2), z.inv_cdf((1 + level) / 2))
        out = []
        for p, a in zip(share, skew, strict=True):
            bias = z.inv_cdf(p) if p is not None and 0 < p < 1 else None
            out.append(None if bias is None else [z.cdf(bias + (bias + e) / (1 - a * (bias + e))) for e in ends])
        return pd.Series(out)

    return F.pandas_udf(cuts, "array<double>")


def _quantile(values: Column, share: Column) -> Column:
    """Between the two of a sorted list that a share falls between."""
    at = share * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    one, two = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return one + (at - low) * (two - one)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def two_sided_p(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution; null without freedom."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, freedoms: pd.Series) -> pd.Series:
        return pd.Series([_incomplete_beta(f / 2, 0.5, f / (f + v * v)) if f > 0 and v == v else None for v, f in zip(ts, freedoms, strict=True)], dtype="float64")

    return p(t.cast("double"), freedom.cast("double"))


def with_p_values(fits: DataFrame) -> DataFrame:
    """Fits of least_squares with the p-value of their slope: a few rows, so a small helper inside tasks does."""
    return fits.withColumn("p", two_sided_p(F.col("t"), F.col("n") - 2))


def weighted_description(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means, standard deviations and correlation of x and y, weighted as least_squares does; n - 1 is not used."""
    w = 1 / F.greatest((F.col("vx") + F.col("vy")) / 2, F.lit(0.01))
    rows = pairs.where("vx is not null and vy is not null").groupBy(*keys).agg(*_sums(w, F.col("x"), F.col("y")))
    mx, my = F.col("sx") / F.col("sw"), F.col("sy") / F.col("sw")
    vx, vy = F.greatest(F.col("sxx") / F.col("sw") - mx * mx, F.lit(0.0)), F.greatest(F.col("syy") / F.col("sw") - my * my, F.lit(0.0))
    corr = F.try_divide(F.col("sxy") / F.col("sw") - mx * my, F.sqrt(vx * vy))
    return rows.select(*keys, "n", mx.alias("mean_x"), my.alias("mean_y"), F.sqrt(vx).alias("std_x"), F.sqrt(vy).alias("std_y"), corr.alias("corr"))


def beta_mixture_2d(pairs: DataFrame, keys: list[str], points: int = 25) -> DataFrame:
    """Density on a grid inside (0, 1) x (0, 1) of users with betas (ax, bx) and (ay, by), each normalised over the grid."""
    xs = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda g: (g + 0.5) / points)

    def curve(a: str, b: str) -> Column:
        return F.transform(xs, lambda x: (F.col(a) - 1) * F.log(x) + (F.col(b) - 1) * F.log(1 - x))

    rows = pairs.select(*keys, curve("ax", "bx").alias("lx"), curve("ay", "by").alias("ly"))
    # Logarithms less their largest: narrow densities stay in range.
    rows = rows.withColumns({c: F.transform(c, _shifted(c)) for c in ("lx", "ly")})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, p: s + p)
    rows = rows.withColumn("total", total("lx") * total("ly"))
    cells = rows.select(*keys, "total", "ly", F.posexplode("lx").alias("gx", "a")).select(*keys, "total", "gx", "a", F.posexplode("ly").alias("gy", "b"))
    sums = cells.groupBy(*keys, "gx", "gy").agg(F.sum(F.col("a") * F.col("b") / F.col("total")).alias("p"))
    whole = F.sum("p").over(Window.partitionBy(*keys))
    return sums.select(*keys, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), (F.col("p") / whole).alias("p"))


def _shifted(column: str):
    return lambda v: F.exp(v - F.array_max(column))


def mixture_mean(density: DataFrame, keys: list[str], low: float, high: float, points: int, inside: bool = False) -> DataFrame:
    """The mean of a density (keys, g, p) over its grid, whose points are its ends or (inside) the middles of its cells."""
    x = F.lit(low) + ((F.col("g") + 0.5) * ((high - low) / points) if inside else F.col("g") * ((high - low) / (points - 1)))
    return density.groupBy(*keys).agg((F.sum(F.col("p") * x) / F.sum("p")).alias("mean"))


def for_each(rows: DataFrame, community: str) -> DataFrame:
    """rows once as community `all` and once as their own, so that one grouping gives both."""
    return rows.withColumn(community, F.explode(F.array(F.lit("all"), F.col(community).cast("string"))))
