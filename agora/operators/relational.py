"""Activity statistics, thread context, samples, splits and histograms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import draws
from agora.operators.ordered import numbered

DAY = 86_400.0


def author_stats(rows: DataFrame, author: str, t: str, item: str) -> DataFrame:
    """Count, first and last time and fractional days of activity of each author that is not null."""
    out = rows.where(F.col(author).isNotNull()).groupBy(author).agg(F.count(item).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    return out.withColumn("days", (F.col("last") - F.col("first")) / DAY)


def topic_activity(rows: DataFrame, author: str, topic: str, topics: list) -> DataFrame:
    """How many rows on the given topics each author has, and on how many of them."""
    on = F.col(topic).isin(topics)
    return rows.where(F.col(author).isNotNull()).groupBy(author).agg(F.count(F.when(on, 1)).alias("on_topic"), F.count_distinct(F.when(on, F.col(topic))).alias("topics"))


def active_users(stats: DataFrame, n: str, least: int, days: str, least_days: float) -> DataFrame:
    return stats.where((F.col(n) >= least) & (F.col(days) >= least_days))


def of_active(rows: DataFrame, author: str, item: str, more_than: int) -> DataFrame:
    """Rows of authors with more than so many items, by a semi join on an aggregate."""
    active = rows.groupBy(author).agg(F.count(item).alias("_n")).where(F.col("_n") > more_than)
    return rows.join(active, author, "left_semi")


def thread_context(rows: DataFrame, thread: str, author: str, active: DataFrame) -> DataFrame:
    """All rows of threads in which an active author takes part."""
    threads = rows.join(active, author, "left_semi").select(thread).distinct()
    return rows.join(threads, thread, "left_semi")


def with_parents(rows: DataFrame, keys: list[str], parent: str, order: str, columns: list[str]) -> DataFrame:
    """Rows with columns of the row that they answer, as <column>_parent; a left self-join."""
    own = rows.select(*keys, F.col(order).alias(parent), *[F.col(c).alias(f"{c}_parent") for c in columns])
    return rows.join(own, [*keys, parent], "left")


def without_orphans(rows: DataFrame, keys: list[str], parent: str, order: str) -> DataFrame:
    """Rows that answer nothing or answer a row that exists."""
    ids = rows.select(*keys, F.col(order).alias(parent)).distinct()
    return rows.where(F.col(parent).isNull()).unionByName(rows.where(F.col(parent).isNotNull()).join(ids, [*keys, parent], "left_semi"))


def outer_counts(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Rows of each side by key, 0 where a side has none; null keys are left out."""
    sides = [d.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n)) for d, n in zip((left, right), names, strict=True)]
    return sides[0].join(sides[1], key, "full").na.fill(0, list(names))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", n.cast("long")).where(F.col("rank") <= k)


def every_kth(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first of every k rows within each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") % k == 1 % k).drop("_n")


def stratified_split(rows: DataFrame, label: str, order: list[Column], shares: tuple[float, ...]) -> DataFrame:
    """split 0, 1, ... within each label, cut at int(share * n); the last takes the rest. Null labels go."""
    rows = numbered(rows.where(F.col(label).isNotNull()), [label], order, "_i")
    split, total = F.lit(len(shares)), F.lit(0)
    cuts = []
    for share in shares:
        total = total + F.floor(F.lit(share) * F.col("_i_of"))
        cuts.append(total)
    for k in reversed(range(len(cuts))):
        split = F.when(F.col("_i") < cuts[k], F.lit(k)).otherwise(split)
    return rows.withColumn("split", split.cast("int")).drop("_i", "_i_of")


def shuffled(rows: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """rows with a place 0, 1, ... in an order drawn by hash of their keys."""
    return numbered(rows.withColumn("_draw", draws.uniform(seed, *keys)), [], [F.col("_draw"), *map(F.col, keys)]).drop("_draw", "place_of")


def hash_sample(rows: DataFrame, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """A share of rows by a hash of their key: the same rows on any cluster."""
    return rows.where(draws.uniform(seed, *keys) < share)


def fixed_sample(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of smallest hash."""
    return rows.orderBy(draws.uniform(seed, *keys), *keys).limit(n)


def sample_again(rows: DataFrame, keys: list[str], share: float, seed: int = 0, parts: int = 64) -> DataFrame:
    """Rows drawn with replacement: each comes a Poisson number of times, `share` on average.

    Its count is how many of `parts` Poisson(1) draws, each taken with probability
    share / parts, come up; a row of several is there several times.
    """
    u = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (draws.uniform(seed, *keys, i) < share / parts).cast("int"))
    times = F.aggregate(u, F.lit(0), lambda a, b: a + b)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).where("_copy > 0").drop("_copy")


def bin_of(x: Column, low: Column | float, high: Column | float, n: int) -> Column:
    """The bin 0..n-1 of x in [low, high], the last closed; null outside."""
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    at = F.floor(F.try_divide((x - low) * n, high - low))
    return F.when((x >= low) & (x <= high), F.least(F.coalesce(at, F.lit(0)), F.lit(n - 1))).cast("long")


def histogram(rows: DataFrame, x: Column, low: float, high: float, n: int, keys: list[str] | None = None) -> DataFrame:
    """Counts and density of each non-empty bin; values outside are dropped."""
    keys = keys or []
    counts = rows.withColumn("bin", bin_of(x, low, high, n)).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (total * ((high - low) / n)))


def histogram_2d(rows: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Counts in n x n bins over the range of the data."""
    edges = rows.agg(*[f(c).alias(f"_{f.__name__}_{k}") for k, c in (("x", x), ("y", y)) for f in (F.min, F.max)])
    out = rows.join(F.broadcast(edges))  # one row
    return out.groupBy(bin_of(F.col(x), F.col("_min_x"), F.col("_max_x"), n).alias("x_bin"), bin_of(F.col(y), F.col("_min_y"), F.col("_max_y"), n).alias("y_bin")).agg(F.count(F.lit(1)).alias("n")).where("x_bin is not null and y_bin is not null")


def best_run(runs: DataFrame, keys: list[str], metric: str, ties: str, least: Column) -> DataFrame:
    """The run of the best metric over 0 for each key, more rows on a tie, among those that meet `least`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col(ties).desc()))
    return runs.where(least & (F.col(metric) > 0)).withColumn("_n", n).where("_n = 1").drop("_n")


def listed(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """A row for each key: the values of every column in order, and how many there are (null keys go).

    Meant for groups that a reader looks at: a list holds all rows of its key.
    """
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    one = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns]))).alias("_rows"))
    return one.select(*keys, *[F.col(f"_rows._{c}").alias(c) for c in columns], F.size("_rows").cast("long").alias("count"))


def largest_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the size of the largest group."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"))


def histogram_moments(bins: DataFrame, keys: list[str], low: float, high: float, n: int) -> DataFrame:
    """Mean and variance of a histogram's bin centers, and its fullest (the lowest of several), first and last bin."""
    x = F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / n)
    rows = bins.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * x).alias("_x"), F.sum(F.col("n") * x * x).alias("_xx"),
        F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode_bin"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"),
    )
    mean = F.col("_x") / F.col("n")
    return rows.withColumn("mean", mean).withColumn("var", F.col("_xx") / F.col("n") - mean * mean).drop("_x", "_xx")


def by_length(rows: DataFrame, sequence: str, item: str, most: int = 256) -> DataFrame:
    """Batches of at most `most` sequences of one length, in order of their items: (length, batch, items, count)."""
    placed = numbered(rows.select(F.size(sequence).cast("long").alias("length"), F.col(item).alias("_item")), ["length"], [F.col("_item")])
    batch = F.floor(F.col("place") / most).alias("batch")
    return placed.groupBy("length", batch).agg(F.sort_array(F.collect_list("_item")).alias("items"), F.count(F.lit(1)).alias("count"))


def of_sample(rows: DataFrame, parents: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows of a hash sample of their parents."""
    return rows.join(hash_sample(parents.select(key).distinct(), [key], share, seed), key, "left_semi")


def in_order(rows: DataFrame, ordered: DataFrame, key: str, columns: list[str], place: str) -> DataFrame:
    """The rows of `ordered` that have a match, with columns of it, in the order of `place`."""
    return ordered.join(rows.select(key, *columns), key).orderBy(place)


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of two tables beside one another by an explicit order of each, as far as the shorter goes."""
    a, b = numbered(left, [], left_order), numbered(right, [], right_order)
    return a.drop("place_of").join(b.drop("place_of"), "place")


def exactly_one(rows: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """asks with the one row of each; an ask with none or several raises."""
    found = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    out = asks.join(found, keys, "left")
    ok = F.coalesce(F.col("_n"), F.lit(0)) == 1
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    return out.withColumn("_n", F.when(ok, 1).otherwise(F.raise_error(F.concat(F.lit("not exactly one row for "), name)))).where("_n = 1").drop("_n")


def latest(asks: DataFrame, rows: DataFrame, keys: list[str], at: str, t: str, order: list[str], columns: list[str]) -> DataFrame:
    """asks with columns of the last row of their key at or before their time (null without one).

    Asks and rows of a key meet in one order, where an ask takes the last row before it.
    """
    mark = rows.select(*keys, F.col(t).alias("_t"), F.struct(*columns).alias("_row"), F.lit(None).cast(_struct(asks)).alias("_ask"), F.struct(*[F.col(c) for c in order]).alias("_o"))
    ask = asks.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(mark.schema["_row"].dataType).alias("_row"), F.struct(*asks.columns).alias("_ask"), F.lit(None).cast(mark.schema["_o"].dataType).alias("_o"))
    both = mark.unionByName(ask).withColumn("_kind", F.col("_ask").isNotNull())
    own = Window.partitionBy(*keys).orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_last", F.last("_row", True).over(own)).where("_kind")
    return both.select("_ask.*", *[F.col(f"_last.{c}").alias(f"last_{c}") for c in columns])


def _struct(rows: DataFrame):
    return rows.select(F.struct(*rows.columns).alias("s")).schema["s"].dataType


def stacked(parts: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(kind, id, text) of several tables under one another; ids are told apart by kind."""
    out = None
    for kind, (rows, key, text) in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), text.alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows, each as often."""
    key = F.struct(*sorted(a.columns))
    both = a.select(key.alias("r"), F.lit(1).alias("d")).unionByName(b.select(key.alias("r"), F.lit(-1).alias("d")))
    apart = both.groupBy("r").agg(F.sum("d").alias("d")).where("d <> 0")
    return apart.agg((F.count(F.lit(1)) == 0).alias("same"))


def row_concat(parts: list[DataFrame], row: str) -> DataFrame:
    """Tables of numbered rows under one another: the rows of each are numbered on after those before."""
    out, before = None, None
    for part in parts:
        size = part.agg((F.max(row) + 1).alias("_n"))
        one = part if before is None else part.join(F.broadcast(before)).withColumn(row, F.col(row) + F.col("_before")).drop("_before")  # one row
        out = one if out is None else out.unionByName(one)
        before = size.select(F.col("_n").alias("_before")) if before is None else before.join(size).select((F.col("_before") + F.col("_n")).alias("_before"))
    return out


def without_columns(rows: DataFrame, pattern: str) -> DataFrame:
    """rows without the columns whose names match."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not re.search(pattern, c)])


def parents(comments: DataFrame, submissions: DataFrame, permalink: Column, parent: Column) -> DataFrame:
    """Comments with their submission's title and text, whether they answer it, and what they answer.

    Needs id, body and author of comments, and permalink, title and selftext of submissions.
    """
    posts = submissions.select(F.col("permalink").alias("post_permalink"), "title", "selftext")
    rows = comments.withColumn("post_permalink", permalink).join(posts, "post_permalink", "left")
    rows = rows.withColumn("is_base_comment", parent.contains("t3_")).withColumn("parent_specific_id", parent_id(parent))
    above = comments.select(F.col("id").alias("parent_specific_id"), F.col("body").alias("body_parent"), F.col("author").alias("author_parent"))
    return rows.join(above, "parent_specific_id", "left")


def parent_id(parent: Column) -> Column:
    from agora.functions.text import bare_id

    return bare_id(parent)


def best_in_steps(runs: DataFrame, keys: list[str], metric: str, ties: str) -> DataFrame:
    """The run of the best metric to four places for each key, the one of more rows among equal ones."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(metric, 4).desc(), F.col(ties).desc()))
    return runs.where(F.round(metric, 4) > 0).withColumn("_n", n).where("_n = 1").drop("_n")


def best_by_class(metrics: DataFrame, keys: list[str], label: str, metric: str) -> DataFrame:
    """For each class the best metric of any run, and its mean over the keys: (label, best, mean)."""
    best = metrics.groupBy(*keys, label).agg(F.max(metric).alias("_best"))
    return best.groupBy(label).agg(F.max("_best").alias("best"), F.avg("_best").alias("mean"), F.count(F.lit(1)).alias("n"))
