"""Opinion timelines over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.draws import normal_sql
from agora.operators import opinions as op
from agora.registry import query
from agora.tables import EDGE_SQL, OBS_SQL, PROFILE_SQL, WEIGHT_SQL, observations, profiles, read, seconds

WEEK = 7 * 86_400
MONDAY = 345_600  # the first Monday after 1970-01-01
VAR_SQL = "CASE WHEN count(value) > 1 THEN round((sum(w * value * value) / nullif(sum(w), 0) - power(sum(w * value) / nullif(sum(w), 0), 2)) * count(value) / (count(value) - 1), 6) + 0.0 END"
WINDOW_SQL = f"span AS (SELECT (min(t) - {MONDAY}) // {WEEK} AS a, max(t) AS z FROM obs), win AS (SELECT i - a AS window_id, {MONDAY} + i * {WEEK} AS lo, {MONDAY} + (i + 1) * {WEEK} AS hi FROM span, generate_series(a, (z - {MONDAY}) // {WEEK}) r(i))"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to six places; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.weighted(observations(spark, sf_dir), profiles(spark))


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks from Monday that hold an event, in one row each; two times reach the driver."""
    low, high = observations(spark, sf_dir).agg(F.min("t"), F.max("t")).first()
    if low is None:
        return op.windows(spark, 0, 0, WEEK)
    start = MONDAY + (low - MONDAY) // WEEK * WEEK
    return op.windows(spark, start, high + 1, WEEK)


@query(f"WITH {WEIGHT_SQL} SELECT user_id, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean, {VAR_SQL} AS var, count(*) AS n FROM wobs GROUP BY 1, 2")
def weighted_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.opinion(weighted(spark, sf_dir), ["user_id", "issue"]), "mean", "var")


@query(f"WITH {WEIGHT_SQL}, {WINDOW_SQL} SELECT window_id, user_id, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean, {VAR_SQL} AS var, count(*) AS n FROM wobs JOIN win ON t >= lo AND t <= hi GROUP BY 1, 2, 3")
def opinion_timeline_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.timeline(weighted(spark, sf_dir), weeks(spark, sf_dir), WEEK), "mean", "var")


@query(f"""WITH {WEIGHT_SQL}, {WINDOW_SQL}, line AS (SELECT window_id, user_id, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean FROM wobs JOIN win ON t >= lo AND t <= hi GROUP BY 1, 2, 3)
SELECT window_id, user_id, issue, mean FROM (SELECT DISTINCT user_id FROM obs) u CROSS JOIN (SELECT DISTINCT issue FROM obs) i CROSS JOIN (SELECT window_id FROM win) w LEFT JOIN line USING (window_id, user_id, issue)""")
def opinion_timeline_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = weighted(spark, sf_dir), weeks(spark, sf_dir)
    line = rounded(op.timeline(rows, spans, WEEK), "mean").select("window_id", "user_id", "issue", "mean")
    return op.complete(line, spans, rows)


@query(f"WITH {WEIGHT_SQL}, {WINDOW_SQL}, aged AS (SELECT window_id, user_id, issue, value, w * power(0.5, floor((hi - t) / 86400.0) / 50.0) AS w FROM wobs JOIN win ON t >= lo AND t <= hi) SELECT window_id, user_id, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean, {VAR_SQL} AS var, count(*) AS n FROM aged GROUP BY 1, 2, 3")
def exp_smoothed_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.timeline(weighted(spark, sf_dir), weeks(spark, sf_dir), WEEK, 50.0), "mean", "var")


@query(f"WITH {OBS_SQL}, p AS (SELECT *, power(0.9, row_number() OVER (PARTITION BY user_id, issue ORDER BY t, comment_id) - 1) AS w FROM obs) SELECT user_id, issue, round(sum(w * value) / sum(w), 6) + 0.0 AS mean FROM p GROUP BY 1, 2")
def position_decay_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.position_decay(observations(spark, sf_dir), 0.1), "mean")


@query(f"WITH {OBS_SQL}, c AS (SELECT *, count(value) OVER (PARTITION BY user_id, issue) AS k FROM obs) SELECT comment_id, user_id, issue FROM c WHERE k >= 20")
def min_stance_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.min_support(observations(spark, sf_dir), 20).select("comment_id", "user_id", "issue")


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def user_mode_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.modal(read(spark, sf_dir, "events"), "user_id", "event_type")


@query(f"WITH {OBS_SQL}, m AS (SELECT user_id, event_type AS modal_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM obs GROUP BY 1, 2) WHERE r = 1) SELECT modal_type, issue, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM obs JOIN m USING (user_id) GROUP BY 1, 2")
def community_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    own = op.modal(obs, "user_id", "event_type").withColumnRenamed("event_type", "modal_type")
    return obs.join(own, "user_id").groupBy("modal_type", "issue").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


#: Three classifiers look at each (user, minute) cell: the first value of each.
CELL_SQL = f"{WEIGHT_SQL}, cell AS (SELECT user_id, issue, classifier_idx, value, w FROM (SELECT *, row_number() OVER (PARTITION BY user_id, issue, classifier_idx ORDER BY t, comment_id) AS r FROM wobs) WHERE r = 1)"


@query(f"""WITH {CELL_SQL}, p AS (SELECT user_id, issue, max(CASE WHEN classifier_idx = 0 THEN value END) AS v0, max(CASE WHEN classifier_idx = 0 THEN w END) AS w0, max(CASE WHEN classifier_idx = 1 THEN value END) AS v1, max(CASE WHEN classifier_idx = 1 THEN w END) AS w1, max(CASE WHEN classifier_idx = 2 THEN value END) AS v2, max(CASE WHEN classifier_idx = 2 THEN w END) AS w2 FROM cell GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN w0 > 0 THEN w0 ELSE 0 END AS b0, CASE WHEN w0 > 0 AND v0 <> 0 AND w0 > 0.5 THEN v0 ELSE 0 END AS l0, CASE WHEN w0 > 0 THEN 0 ELSE -1 END AS i0 FROM p),
b AS (SELECT *, CASE WHEN w1 > b0 THEN w1 ELSE b0 END AS b1, CASE WHEN w1 > b0 AND v1 <> 0 AND w1 > 0.5 THEN v1 ELSE l0 END AS l1, CASE WHEN w1 > b0 THEN 1 ELSE i0 END AS i1 FROM a)
SELECT user_id, issue, CASE WHEN w2 > b1 AND v2 <> 0 AND w2 > 0.5 THEN v2 ELSE l1 END AS value, CASE WHEN w2 > b1 THEN 2 ELSE i1 END AS classifier_idx, round(CASE WHEN w2 > b1 THEN w2 ELSE b1 END, 6) AS w FROM b""")
def ensemble_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighted(spark, sf_dir)
    first = rows.groupBy("user_id", "issue", "classifier_idx").agg(F.min_by(F.struct("value", "w"), F.struct("t", "comment_id")).alias("f"))
    cells = first.select("user_id", "issue", "classifier_idx", "f.value", "f.w")
    return rounded(op.ensemble(cells, ["user_id", "issue"]), "w")


@query(f"WITH {CELL_SQL} SELECT user_id, issue, max(CASE WHEN classifier_idx = 0 THEN value END) AS c0, max(CASE WHEN classifier_idx = 1 THEN value END) AS c1, max(CASE WHEN classifier_idx = 2 THEN value END) AS c2 FROM cell GROUP BY 1, 2 HAVING count(*) = 3")
def combined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighted(spark, sf_dir)
    first = rows.groupBy("user_id", "issue", "classifier_idx").agg(F.min_by("value", F.struct("t", "comment_id")).alias("value"))
    wide = first.groupBy("user_id", "issue").pivot("classifier_idx", [0, 1, 2]).agg(F.first("value"))
    return wide.dropna().withColumnsRenamed({"0": "c0", "1": "c1", "2": "c2"})


@query(f"WITH {PROFILE_SQL} SELECT CAST(classifier_idx AS INTEGER) AS classifier_idx, CAST(v AS INTEGER) AS value, round(CAST(sum(CASE WHEN true_value = v AND pred_value = v THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN pred_value = v THEN n ELSE 0 END), 0), 6) AS w, round(CAST(sum(CASE WHEN true_value = v AND pred_value = v THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN true_value = v THEN n ELSE 0 END), 0), 6) AS recall FROM profile, (VALUES (-1), (0), (1)) l(v) GROUP BY 1, 2")
def profile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = profiles(spark)
    return rounded(op.precisions(profile).join(op.recalls(profile), ["classifier_idx", "value"]), "w", "recall")


@query(f"WITH {OBS_SQL} SELECT user_id, issue, string_agg(CAST(value AS VARCHAR), ',' ORDER BY t, comment_id) AS vals FROM obs GROUP BY 1, 2")
def opinion_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.sequences(observations(spark, sf_dir))
    return rows.select("user_id", "issue", F.array_join(F.transform("rows", lambda r: r["value"].cast("string")), ",").alias("vals"))


@query("""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, max(o_orderdate) AS hi FROM orders), m AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS s, hi FROM b)
SELECT CAST(year(s) * 12 + month(s) AS BIGINT) AS window_id, CAST(epoch(s) AS BIGINT) AS lo, CAST(epoch(s + INTERVAL 1 MONTH) AS BIGINT) AS hi FROM m WHERE s < hi""")
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return op.months(orders.select(seconds(orders, "o_orderdate").alias("t")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")))


@query("""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, max(o_orderdate) AS hi FROM orders), m AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS s, hi FROM b), w AS (SELECT CAST(year(s) * 12 + month(s) AS BIGINT) AS window_id, CAST(epoch(s) AS BIGINT) AS lo, CAST(epoch(s + INTERVAL 1 MONTH) AS BIGINT) AS hi FROM m WHERE s < hi)
SELECT window_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN w ON epoch(o_orderdate) >= lo AND epoch(o_orderdate) <= hi GROUP BY 1""")
def monthly_orders_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    rows = orders.select(seconds(orders, "o_orderdate").alias("t"), "o_totalprice")
    spans = op.months(rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    found = op.in_windows(rows, spans, 31 * 86_400)
    return found.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn <= 1 THEN NULL ELSE turn - 1 END AS parent FROM conversations)
SELECT a.conv_id, a.turn, string_agg(CAST(b.turn AS VARCHAR), ',' ORDER BY b.turn) AS candidates, CAST(CASE WHEN any_value(a.parent) IS NULL THEN 0 ELSE greatest(count(*) FILTER (b.turn < a.parent), 0) END AS BIGINT) AS chosen FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1, 2""")
def reply_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("parent", F.when(F.col("turn") > 1, F.col("turn") - 1))
    rows = op.reply_candidates(turns, "conv_id", "turn", "text", "parent")
    return rows.select("conv_id", "turn", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), "chosen")


SYNTHETIC_SQL = f"made AS (SELECT id AS comment_id, id // 100 AS user_id, -1.0::DOUBLE + (id // 100) * (2.0::DOUBLE / 9) AS truth FROM range(1000) r(id)), drawn AS (SELECT *, greatest(-1, least(1, truth + {normal_sql(0, 'comment_id')} * 0.5)) AS d FROM made), syn AS (SELECT *, CASE WHEN d > 1.0::DOUBLE / 3 THEN 1 WHEN d < -1.0::DOUBLE / 3 THEN -1 ELSE 0 END AS value FROM drawn)"


@query(f"WITH {SYNTHETIC_SQL} SELECT user_id, round(truth, 6) AS truth, round(avg(value), 6) + 0.0 AS mean, round(var_samp(value), 6) AS var, count(*) AS n FROM syn GROUP BY 1, 2")
def synthetic_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten made users, seen by a perfect classifier: there is no table to read."""
    rows = op.synthetic(spark, 10, 100, 0.5, 0)
    return rounded(op.opinion(op.weighted(rows, profiles(spark)), ["user_id", "truth"]), "truth", "mean", "var")


#: Six runs of a classifier for each issue, two for each focus label; a run errs on every fourth comment.
BEST_SQL = f"""{OBS_SQL}, seen AS (SELECT issue, count(*) AS num_comments FROM obs GROUP BY 1), runs AS (SELECT issue, CAST(run % 3 AS INTEGER) AS focus, run, ((issue * 7 + run * 3) % 10) / 10.0::DOUBLE AS metric, CASE WHEN (issue + run) % 5 = 0 THEN 0.5::DOUBLE ELSE 0.6 + run / 20.0::DOUBLE END AS precision, num_comments + run % 2 AS num_comments FROM seen, range(6) r(run)),
best AS (SELECT issue, focus, run, precision AS w FROM (SELECT *, row_number() OVER (PARTITION BY issue, focus ORDER BY metric DESC, num_comments DESC, run DESC) AS k FROM runs WHERE precision > 0.5 AND metric > 0 AND issue <> 2) WHERE k = 1),
said AS (SELECT b.issue, comment_id, focus, w, CASE WHEN (comment_id + run) % 4 = 0 THEN 0 ELSE value END AS value FROM obs JOIN best b USING (issue) WHERE comment_id % 7 <> run),
full_ AS (SELECT issue, comment_id FROM said GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM best WHERE best.issue = said.issue)),
wide AS (SELECT issue, comment_id, max(CASE WHEN focus = 0 THEN value END) AS v0, max(CASE WHEN focus = 0 THEN w END) AS w0, max(CASE WHEN focus = 1 THEN value END) AS v1, max(CASE WHEN focus = 1 THEN w END) AS w1, max(CASE WHEN focus = 2 THEN value END) AS v2, max(CASE WHEN focus = 2 THEN w END) AS w2 FROM said JOIN full_ USING (issue, comment_id) GROUP BY 1, 2),
a AS (SELECT *, coalesce(w0, 0) AS b0, CASE WHEN w0 > 0.5 AND v0 <> 0 THEN v0 ELSE 0 END AS l0 FROM wide), b AS (SELECT *, CASE WHEN w1 > b0 THEN w1 ELSE b0 END AS b1, CASE WHEN w1 > b0 AND v1 <> 0 THEN v1 ELSE l0 END AS l1 FROM a)"""


@query(f"WITH {BEST_SQL} SELECT issue, comment_id, CASE WHEN w2 > b1 AND v2 <> 0 THEN v2 ELSE l1 END AS value, round(CASE WHEN w2 > b1 THEN w2 ELSE b1 END, 6) AS w FROM b")
def best_run_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stance for each comment from the best runs of each focus label; issue 2 is left out by name."""
    obs = observations(spark, sf_dir).select("issue", "comment_id", "value")
    issue, run = F.col("issue"), F.col("run")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("run")
    runs = obs.groupBy("issue").agg(F.count(F.lit(1)).alias("seen")).select("issue", "seen", every).select(
        "issue", (run % 3).cast("int").alias("focus"), "run", ((issue * 7 + run * 3) % 10 / 10.0).alias("metric"),
        F.when((issue + run) % 5 == 0, 0.5).otherwise(F.lit(0.6) + run / 20.0).alias("precision"), (F.col("seen") + run % 2).alias("num_comments"),
    )
    said = obs.select("issue", "comment_id", "value", every).where("comment_id % 7 <> run")
    said = said.select("run", "issue", "comment_id", F.when((F.col("comment_id") + run) % 4 == 0, 0).otherwise(F.col("value")).alias("value"))
    return rounded(op.from_best_runs(runs, said, ("2",)), "w").select("issue", "comment_id", "value", "w")


EDGES = EDGE_SQL
