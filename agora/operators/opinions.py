"""Opinion timelines: weights, means and variances of stance observations by user, issue and window.

Observations are in long form (comment_id, user_id, t, issue, value, classifier_idx);
value is -1, 0, 1 or null. Nothing is padded, and missing cells are rows that do not exist.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import draws

DAY = 86_400


def precisions(profile: DataFrame) -> DataFrame:
    """(classifier_idx, value, w): the share of right ones among a classifier's predictions of a value."""
    right = F.sum(F.when(F.col("true_value") == F.col("pred_value"), F.col("n")).otherwise(0)).cast("double")
    return profile.groupBy("classifier_idx", F.col("pred_value").alias("value")).agg(F.try_divide(right, F.sum("n")).alias("w"))


def recalls(profile: DataFrame) -> DataFrame:
    """(classifier_idx, value, recall) of each true value."""
    right = F.sum(F.when(F.col("true_value") == F.col("pred_value"), F.col("n")).otherwise(0)).cast("double")
    return profile.groupBy("classifier_idx", F.col("true_value").alias("value")).agg(F.try_divide(right, F.sum("n")).alias("recall"))


def weighted(obs: DataFrame, profile: DataFrame) -> DataFrame:
    """Observations with the precision w of their classifier for their value.

    A profile has nine rows for each classifier, which the join may broadcast by its size.
    """
    return obs.join(precisions(profile), ["classifier_idx", "value"])


def mean_column(w: Column, x: Column) -> Column:
    return F.try_divide(F.sum(w * x), F.sum(w))


def variance_column(w: Column, x: Column) -> Column:
    """Weighted variance with the n / (n - 1) correction; null for one observation."""
    n = F.count(x)
    mean = mean_column(w, x)
    square = F.try_divide(F.sum(w * x * x), F.sum(w)) - mean * mean
    return F.when(n > 1, square * n / F.when(n > 1, n - 1))


def opinion(obs: DataFrame, keys: list[str], w: Column | None = None) -> DataFrame:
    """Weighted mean and variance of value by keys."""
    w = F.col("w") if w is None else w
    x = F.col("value").cast("double")
    return obs.where("value is not null").groupBy(*keys).agg(mean_column(w, x).alias("mean"), variance_column(w, x).alias("var"), F.count(F.lit(1)).alias("n"))


def windows(spark, low: int, high: int, width: int) -> DataFrame:
    """(window_id, lo, hi): windows of `width` seconds from low on, while they begin before high; ends are shared."""
    n = max(0, -(-(high - low) // width))
    i = F.col("id")
    return spark.range(n).select(i.alias("window_id"), (i * width + low).alias("lo"), (i * width + low + width).alias("hi"))


def months(bounds: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """(window_id, lo, hi) in seconds: calendar months in UTC from the first's start, while they begin before the last time.

    Days are counted from 1970, so no result depends on the session's time zone.
    """
    first = F.lit("1970-01-01").cast("date")
    day = lambda c: F.date_add(first, F.floor(F.col(c) / DAY).cast("int"))
    steps = F.explode(F.sequence(F.trunc(day(low), "month"), day(high), F.expr("interval 1 month"))).alias("s")
    seconds = lambda d: F.datediff(d, first).cast("long") * DAY
    out = bounds.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(steps, F.col(high).alias("_high"))
    out = out.select((F.year("s") * 12 + F.month("s")).cast("long").alias("window_id"), seconds(F.col("s")).alias("lo"), seconds(F.add_months("s", 1)).alias("hi"), "_high")
    return out.where("lo < _high").drop("_high")


def in_windows(rows: DataFrame, spans: DataFrame, width: int, t: str = "t", ends: bool = True) -> DataFrame:
    """Rows with each window that holds their time, both ends included, or (not `ends`) the first alone.

    Windows are cut at multiples of `width`; a row meets a window by an equal cell and the
    bounds are tested again, so there is no nested loop over rows and windows.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    rows = rows.withColumn("_cell", F.floor(F.col(t) / width))
    before = F.col(t) <= F.col("hi") if ends else F.col(t) < F.col("hi")
    return rows.join(cells, "_cell").where((F.col(t) >= F.col("lo")) & before).drop("_cell")


def age_in_days(t: Column, end: Column) -> Column:
    return F.floor((end - t) / DAY)


def decay(days: Column, halflife: float) -> Column:
    return F.pow(F.lit(0.5), days / halflife)


def timeline(obs: DataFrame, spans: DataFrame, width: int, halflife: float | None = None) -> DataFrame:
    """Mean and variance by window, user and issue; with a half-life, w also halves for each so many days before the window's end."""
    rows = in_windows(obs, spans, width)
    w = F.col("w") if halflife is None else F.col("w") * decay(age_in_days(F.col("t"), F.col("hi")), halflife)
    return opinion(rows, ["window_id", "user_id", "issue"], w)


def complete(line: DataFrame, spans: DataFrame, obs: DataFrame) -> DataFrame:
    """A row for every window, user and issue, null where there is no observation.

    Its size is the product of the three; a caller that wants less gives fewer spans, or
    observations of fewer users. Spans and issues are few, and each user makes its cells
    where it stands.
    """
    issues = obs.agg(F.sort_array(F.collect_set("issue")).alias("_issues"))
    cells = spans.agg(F.sort_array(F.collect_set("window_id")).alias("_windows")).join(issues)
    users = obs.select("user_id").distinct().join(F.broadcast(cells))  # one row
    cells = users.select("user_id", F.explode("_issues").alias("issue"), "_windows").select("user_id", "issue", F.explode("_windows").alias("window_id"))
    return cells.join(line, ["window_id", "user_id", "issue"], "left")


def position_decay(obs: DataFrame, alpha: float) -> DataFrame:
    """Mean by user and issue with weights (1 - alpha)**position, the first observation at 0."""
    order = Window.partitionBy("user_id", "issue").orderBy("t", "comment_id")
    rows = obs.where("value is not null").withColumn("w", F.pow(F.lit(1 - alpha), F.row_number().over(order) - 1))
    return rows.groupBy("user_id", "issue").agg(mean_column(F.col("w"), F.col("value").cast("double")).alias("mean"))


def min_support(obs: DataFrame, least: int) -> DataFrame:
    """Observations without those of issues on which a user has fewer than `least`."""
    n = F.count("value").over(Window.partitionBy("user_id", "issue"))
    return obs.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def modal(rows: DataFrame, key: str, attribute: str) -> DataFrame:
    """The most frequent value of an attribute for each key; the smallest of equally frequent ones."""
    return rows.where(F.col(attribute).isNotNull()).groupBy(key).agg(F.mode(attribute, True).alias(attribute))


def ensemble(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """One label for rows (keys, classifier_idx, value, w) of several classifiers.

    In the order of classifiers: where a precision beats the best so far it becomes the
    best, and its label is taken if it is not neutral and the precision is over a half.
    """
    runs = F.array_sort(F.collect_list(F.struct("classifier_idx", "value", "w")))
    start = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("label"), F.lit(-1).alias("idx"))

    def step(state: Column, run: Column) -> Column:
        better = run["w"] > state["best"]
        taken = better & (run["value"] != 0) & (run["w"] > 0.5)
        return F.struct(
            F.when(better, run["w"]).otherwise(state["best"]).alias("best"),
            F.when(taken, run["value"]).otherwise(state["label"]).alias("label"),
            F.when(better, run["classifier_idx"]).otherwise(state["idx"]).alias("idx"),
        )

    folded = predictions.groupBy(*keys).agg(F.aggregate(runs, start, step).alias("f"))
    return folded.select(*keys, F.col("f.label").alias("value"), F.col("f.idx").alias("classifier_idx"), F.col("f.best").alias("w"))


def sequences(obs: DataFrame) -> DataFrame:
    """The values of each user and issue in order of time, as one array.

    Meant for export of single users: an array holds all of a user's observations.
    """
    rows = F.array_sort(F.collect_list(F.struct("t", "comment_id", "value", "classifier_idx")))
    return obs.where("value is not null").groupBy("user_id", "issue").agg(rows.alias("rows"))


#: Weights of observations by the name of an aggregation: from the precision w, the age in days and the half-life.
WEIGHTS: dict[str, Callable[[Column, Column, float], Column]] = {
    "weighted": lambda w, days, halflife: w,
    "exponential": lambda w, days, halflife: w * decay(days, halflife),
}
#: Aggregations that infer the share of each stance behind the classifiers' answers.
INFERRED = ("categorical", "normal", "beta")


@dataclass
class OpinionTimeline:
    """Observations, classifier profiles and how to aggregate them.

    aggregation: a name of WEIGHTS, which a caller may extend, or of INFERRED; least: the
    fewest observations of a user on an issue; attribute: a column whose modal value each
    user gets.
    """

    obs: DataFrame
    profile: DataFrame
    aggregation: str = "weighted"
    halflife: float = 50.0
    least: int = 1
    attribute: str | None = None
    required: tuple[str, ...] = field(default=("comment_id", "user_id", "t", "issue", "value", "classifier_idx"), repr=False)

    def __post_init__(self) -> None:
        missing = [c for c in self.required if c not in self.obs.columns]
        if missing:
            raise ValueError(f"observations lack {', '.join(missing)}")
        if self.aggregation not in WEIGHTS and self.aggregation not in INFERRED:
            raise ValueError(f"unknown aggregation {self.aggregation}")
        self.rows = weighted(min_support(self.obs, self.least), self.profile)

    def _opinions(self, rows: DataFrame, keys: list[str], end: Column) -> DataFrame:
        if self.aggregation in INFERRED:
            from agora.operators import inference

            return getattr(inference, self.aggregation)(inference.posterior(rows.drop("w"), self.profile), keys)
        return opinion(rows, keys, WEIGHTS[self.aggregation](F.col("w"), age_in_days(F.col("t"), end), self.halflife))

    def data(self, spans: DataFrame, width: int, ends: bool = True) -> DataFrame:
        out = self._opinions(in_windows(self.rows, spans, width, ends=ends), ["window_id", "user_id", "issue"], F.col("hi"))
        return out.join(modal(self.obs, "user_id", self.attribute), "user_id", "left") if self.attribute else out

    def window(self, low: int, high: int) -> DataFrame:
        return self._opinions(self.rows.where(F.col("t").between(low, high)), ["user_id", "issue"], F.lit(high))

    def user(self, user_id) -> DataFrame:
        return self.obs.where(F.col("user_id") == user_id)


def reply_candidates(turns: DataFrame, thread: str, order: str, text: str, parent: str, within: int | None = None) -> DataFrame:
    """For each later turn, the candidates it could answer, the post first, and which it did (0 the post).

    Without `within` a candidate list is the whole thread before a turn, so its size is the
    thread's length squared; with it, it holds the post and the last `within` turns. A turn
    that answers none of them has chosen the post.
    """
    own = Window.partitionBy(thread).orderBy(order)
    before = F.collect_list(order).over(own.rowsBetween(-within if within else Window.unboundedPreceding, -1))
    rows = turns.withColumn("candidates", before).withColumn("_post", F.first(order).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where(F.size("candidates") > 0)
    post = F.array(F.col("_post"))
    rows = rows.withColumn("candidates", F.when(F.col("candidates")[0] == F.col("_post"), F.col("candidates")).otherwise(F.concat(post, F.col("candidates")))).drop("_post")
    chosen = F.when(F.col(parent).isNull(), 0).otherwise(F.greatest(F.array_position("candidates", F.col(parent)) - 1, F.lit(0)))
    return rows.withColumn("chosen", chosen.cast("long"))


def reply_pairs(turns: DataFrame, thread: str, order: str, parent: str, x: str, within: int | None = None) -> DataFrame:
    """(thread, order, candidate, distance, chosen) of the turns a turn could answer: all before it, or the last `within`.

    distance is that of the two turns' x; chosen marks the parent. Turns without a parent go.
    """
    last = Window.partitionBy(thread).orderBy(order).rowsBetween(-within if within else Window.unboundedPreceding, -1)
    rows = turns.withColumn("_c", F.collect_list(F.struct(F.col(order).alias("candidate"), F.col(x).alias("_x"))).over(last)).where(F.col(parent).isNotNull())
    rows = rows.withColumn("_c", F.explode("_c"))
    return rows.select(thread, order, F.col("_c.candidate").alias("candidate"), F.abs(F.col("_c._x") - F.col(x)).alias("distance"), (F.col("_c.candidate") == F.col(parent)).cast("int").alias("chosen"))


def synthetic(spark, users: int, points: int, spread: float, seed: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Observations of users whose true stances go evenly from low to high: a normal draw, clipped, cut at thirds."""
    rows = spark.range(users * points).select(F.col("id").alias("comment_id"), F.floor(F.col("id") / points).alias("user_id"), (F.col("id") % points).alias("t"))
    truth = F.lit(low) + F.col("user_id") * ((high - low) / max(users - 1, 1))
    draw = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), truth + draws.normal(seed, "comment_id") * spread))
    value = F.when(draw > 1 / 3, 1).when(draw < -1 / 3, -1).otherwise(0)
    return rows.withColumn("truth", truth).withColumn("value", value).withColumn("issue", F.lit(0).cast("long")).withColumn("classifier_idx", F.lit(0))


def from_best_runs(runs: DataFrame, predictions: DataFrame, exclude: tuple[str, ...] = (), least_precision: float = 0.5) -> DataFrame:
    """One stance for each comment and issue, folded from the best run of each focus label.

    runs is (issue, focus, run, metric, precision, num_comments); predictions (run, issue,
    comment_id, value). For each issue and focus the run of the best metric over 0 is taken
    among those of enough precision, the larger one on a tie; comments need a prediction of
    each focus that its issue has a run for. Predictions are folded in the order of focus,
    as ensemble() does. Issues in `exclude` are left out.
    """
    from agora.operators.relational import best_run

    kept = runs.where(~F.col("issue").cast("string").isin(*exclude)) if exclude else runs
    best = best_run(kept.withColumn("_ties", F.struct("num_comments", "run")), ["issue", "focus"], "metric", "_ties", F.col("precision") > least_precision)
    foci = best.groupBy("issue").agg(F.count(F.lit(1)).alias("_foci"))
    # A row for each issue and focus: small beside the predictions.
    chosen = best.select("issue", "run", F.col("focus").alias("classifier_idx"), F.col("precision").alias("w")).join(foci, "issue")
    rows = predictions.join(chosen, ["issue", "run"])
    folded = ensemble(rows, ["issue", "comment_id"])
    whole = rows.groupBy("issue", "comment_id").agg(F.count_distinct("classifier_idx").alias("_n"), F.first("_foci").alias("_foci")).where("_n = _foci")
    return folded.join(whole.select("issue", "comment_id"), ["issue", "comment_id"])


def from_simulator(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Observations (comment_id, user_id, t, issue, value, classifier_idx) of a simulation's posts and comments.

    The stance of a text is its position on the nearest of -1, 0, 1; comments are numbered after posts.
    """
    from agora.operators.dynamics import nearest_stance

    parts = []
    for kind, rows in ((0, posts), (1, comments)):
        parts.append(rows.select(F.xxhash64(F.lit(kind), "replica", "id").alias("comment_id"), "replica", "user_id", F.col("time").alias("t"), F.lit(0).cast("long").alias("issue"), nearest_stance(F.col("position")).alias("value"), F.lit(0).alias("classifier_idx")))
    return parts[0].unionByName(parts[1])
