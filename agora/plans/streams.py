"""Interactions, stance rules and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.operators import interactions as it
from agora.operators import stance as st
from agora.plans.opinions import VAR_SQL, rounded
from agora.plans.relational import TOLD_SQL, answers
from agora.registry import query
from agora.sources import store
from agora.sources.store import shared_folder
from agora.streaming import opinions as so
from agora.tables import OBS_SQL, WEIGHT_SQL, observations, profiles, read

#: A user's content is the embedding of the event's number, what they viewed another one.
CONTENT_SQL = f"""{OBS_SQL}, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), many AS (SELECT count(*) AS many FROM embeddings),
c AS (SELECT comment_id, user_id, t, event_type, a.v AS own, b.v AS viewed, lag(a.v) OVER (PARTITION BY user_id ORDER BY t, comment_id) AS prev FROM obs, many JOIN v a ON a.vec_id = comment_id % many JOIN v b ON b.vec_id = (comment_id * 7 + 3) % many)"""
_EUCLID = "sqrt(list_sum(list_transform(generate_series(1, len({a})), lambda k: power({a}[k] - {b}[k], 2))))"
_DOT = "list_sum(list_transform(generate_series(1, len({a})), lambda k: {a}[k] * {b}[k]))"
_COSINE = f"{_DOT} / (sqrt({_DOT.replace('{b}', '{a}')}) * sqrt({_DOT.replace('{a}', '{b}')}))"


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.with_previous(_content(spark, sf_dir), "user_id", ["t", "comment_id"], "own")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("comment_id", "user_id", "t", "event_type")
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = obs.join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("many"))))  # one row
    rows = rows.withColumn("own_id", F.col("comment_id") % F.col("many")).withColumn("viewed_id", (F.col("comment_id") * 7 + 3) % F.col("many")).drop("many")
    return rows.join(vectors.toDF("own_id", "own"), "own_id").join(vectors.toDF("viewed_id", "viewed"), "viewed_id")


def keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All content with the keys own_id and prev_id of its vectors (prev_id null for a user's first), and (key, vector).

    Rows are the same as content()'s and those of users with one row; they are kept, as they are read often.
    """
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = observations(spark, sf_dir).select("comment_id", "user_id", "t").join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("many"))))  # one row
    rows = rows.withColumn("own_id", F.col("comment_id") % F.col("many")).withColumn("_viewed", (F.col("comment_id") * 7 + 3) % F.col("many")).drop("many")
    for c in ("own_id", "_viewed"):
        rows = rows.join(vectors.select(F.col("vec_id").alias(c)), c, "left_semi")
    return store.saved(it.with_previous(rows.drop("_viewed"), "user_id", ["t", "comment_id"], "own_id", least=1).withColumnRenamed("prev", "prev_id"), "keyed"), vectors


def asked(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every hundredth event of a user who wrote before, with both vectors."""
    asks = rows.where("comment_id % 100 = 0 and prev_id is not null").select(F.col("comment_id").alias("ask"), "user_id", F.col("t").alias("at"), "own_id", "prev_id")
    double = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return asks.join(double.toDF("own_id", "own"), "own_id").join(double.toDF("prev_id", "prev"), "prev_id").drop("own_id", "prev_id")


def dimensions(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max(F.size("embedding"))).first()[0] or 0


DISTANCE_SQL = f"{CONTENT_SQL}, d AS (SELECT comment_id, {_EUCLID.format(a='prev', b='own')} AS prev_user_euclid_dist, {_COSINE.format(a='prev', b='own')} AS prev_user_cosine_sim, {_EUCLID.format(a='viewed', b='own')} AS viewed_user_euclid_dist, {_COSINE.format(a='viewed', b='own')} AS viewed_user_cosine_sim, {_EUCLID.format(a='viewed', b='prev')} AS viewed_prev_euclid_dist FROM c WHERE prev IS NOT NULL)"


@query(f"WITH {DISTANCE_SQL} SELECT comment_id, round(prev_user_euclid_dist, 6) AS prev_user_euclid_dist, round(prev_user_cosine_sim, 6) + 0.0 AS prev_user_cosine_sim, round(viewed_user_euclid_dist, 6) AS viewed_user_euclid_dist, round(viewed_user_cosine_sim, 6) + 0.0 AS viewed_user_cosine_sim FROM d")
def interaction_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = it.distances(content(spark, sf_dir).where("prev is not null"), {"prev_user": ("prev", "own"), "viewed_user": ("viewed", "own")})
    columns = [f"{p}_{k}" for p in ("prev_user", "viewed_user") for k in ("euclid_dist", "cosine_sim")]
    return rounded(rows.select("comment_id", *columns), *columns)


@query(f"WITH {DISTANCE_SQL}, m AS (SELECT 1 / (1 + exp(viewed_user_euclid_dist - prev_user_euclid_dist)) AS x FROM d) SELECT CAST(least(floor(x * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM m WHERE x >= 0 AND x <= 1 GROUP BY 1")
def movement_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.operators.relational import histogram

    rows = it.distances(content(spark, sf_dir).where("prev is not null"), {"prev_user": ("prev", "own"), "viewed_user": ("viewed", "own"), "viewed_prev": ("viewed", "prev")})
    moved = it.movement(rows, "prev_user_euclid_dist", {"viewed": ("viewed_user_euclid_dist", "viewed_prev_euclid_dist")})
    return histogram(moved, F.col("viewed_between"), 0.0, 1.0, 20).select("bin", "n")


@query(f"""WITH {CONTENT_SQL}, x AS (SELECT user_id, comment_id, t, unnest(generate_series(1, len(own))) - 1 AS dim, unnest(own) AS v FROM c) SELECT comment_id, round(sum(b * b), 6) AS before_square, round(sum(a * a), 6) AS after_square FROM (SELECT comment_id, avg(v) OVER (PARTITION BY user_id, dim ORDER BY t, comment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, avg(v) OVER (PARTITION BY user_id, dim ORDER BY t, comment_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM x) GROUP BY 1 HAVING sum(b * b) IS NOT NULL""")
def changepoint_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.functions.vectors import dot

    rows, vectors = keyed(spark, sf_dir)
    # A user with one row has nothing before it.
    rows = it.before_and_after(rows, "user_id", ["t", "comment_id"], "comment_id", "own_id", vectors).where("before is not null")
    return rounded(rows.select("comment_id", dot(F.col("before"), F.col("before")).alias("before_square"), dot(F.col("after"), F.col("after")).alias("after_square")), "before_square", "after_square")


#: Who answered whom: the user before on the same issue and day, where the event is an error.
LINK_SQL = "link AS (SELECT user_id AS src, dst FROM (SELECT user_id, event_type, lag(user_id) OVER (PARTITION BY issue, t // 86400 ORDER BY t, comment_id) AS dst FROM obs) WHERE event_type = 'error' AND dst IS NOT NULL AND dst <> user_id), linked AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    before = F.lag("user_id").over(Window.partitionBy("issue", "day").orderBy("t", "comment_id"))
    return rows.withColumn("dst", before).where("event_type = 'error' and dst is not null").select(F.col("user_id").alias("src"), "dst")


AROUND_SQL = f"""{CONTENT_SQL}, ask AS (SELECT comment_id AS ask, user_id, t AS asked, own, prev FROM c WHERE comment_id % 100 = 0 AND prev IS NOT NULL),
near AS (SELECT ask, item, author, own FROM (SELECT ask.ask, c.comment_id AS item, c.user_id AS author, c.own, row_number() OVER (PARTITION BY ask.ask ORDER BY c.t, c.comment_id) AS r, count(*) OVER (PARTITION BY ask.ask) AS n FROM ask JOIN c ON c.t >= asked - 604800 AND c.t <= asked) WHERE r > 1 AND r < n)"""
_SPREAD = "unnest(generate_series(1, len({v}))) AS k, unnest({v}) AS x"
_COMPARE = "round(sqrt(sum(power(m - o, 2))), 6) AS user_euclid_dist, round(sum(m * o) / (sqrt(sum(m * m)) * sqrt(sum(o * o))), 6) + 0.0 AS user_cosine_sim, round(sqrt(sum(power(m - p, 2))), 6) AS prev_euclid_dist, round(sum(m * p) / (sqrt(sum(m * m)) * sqrt(sum(p * p))), 6) + 0.0 AS prev_cosine_sim"


def compared(rows: DataFrame, keys: list[str], mean: str) -> DataFrame:
    """Distances of a mean from the user's content and from what they wrote before."""
    found = it.distances(rows, {"user": (mean, "own"), "prev": (mean, "prev")})
    return rounded(found.select(*keys, *[f"{p}_{k}" for p in ("user", "prev") for k in ("euclid_dist", "cosine_sim")]), *[f"{p}_{k}" for p in ("user", "prev") for k in ("euclid_dist", "cosine_sim")])


@query(f"WITH {AROUND_SQL}, d AS (SELECT ask, k, avg(x) AS m, count(*) AS n FROM (SELECT ask, {_SPREAD.format(v='own')} FROM near) GROUP BY 1, 2), o AS (SELECT ask, unnest(generate_series(1, len(own))) AS k, unnest(own) AS o, unnest(prev) AS p FROM ask) SELECT ask, max(n) AS n, {_COMPARE} FROM d JOIN o USING (ask, k) GROUP BY 1")
def global_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of a week's content from what a user then wrote, for every hundredth event against all content."""
    rows, vectors = keyed(spark, sf_dir)
    found = it.global_means(rows, asked(rows, vectors), "t", "comment_id", "own_id", "at", 604_800, dimensions(spark, sf_dir), vectors).where("global_n > 0")
    return compared(found.withColumnRenamed("global_n", "n"), ["ask", "n"], "global_content")


@query(f"""WITH {AROUND_SQL}, {LINK_SQL}, u AS (SELECT DISTINCT user_id AS u FROM ask), r1 AS (SELECT DISTINCT u, dst AS node FROM u JOIN linked ON src = u WHERE dst <> u), r2 AS (SELECT DISTINCT u, dst AS node FROM r1 JOIN linked ON src = node WHERE dst <> u AND (u, dst) NOT IN (SELECT u, node FROM r1)), r3 AS (SELECT DISTINCT u, dst AS node FROM r2 JOIN linked ON src = node WHERE dst <> u AND (u, dst) NOT IN (SELECT u, node FROM r1) AND (u, dst) NOT IN (SELECT u, node FROM r2)),
ring AS (SELECT u, node, 1 AS ring FROM r1 UNION ALL SELECT u, node, 2 FROM r2 UNION ALL SELECT u, node, 3 FROM r3), d AS (SELECT ask, ring, k, avg(x) AS m, count(*) AS n FROM (SELECT near.ask, ring, {_SPREAD.format(v='near.own')} FROM near JOIN ask ON ask.ask = near.ask JOIN ring ON u = user_id AND node = author) GROUP BY 1, 2, 3), o AS (SELECT ask, unnest(generate_series(1, len(own))) AS k, unnest(own) AS o, unnest(prev) AS p FROM ask) SELECT ask, ring, max(n) AS n, {_COMPARE} FROM d JOIN o USING (ask, k) GROUP BY 1, 2""")
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the content of first, second and third neighbours."""
    (rows, vectors), dims = keyed(spark, sf_dir), dimensions(spark, sf_dir)
    asks = asked(rows, vectors)
    found = it.ring_means(rows, asks, links(spark, sf_dir), vectors, "user_id", "user_id", "t", "comment_id", "own_id", "at", 604_800, dims, "ask")
    return compared(found.join(asks.select("ask", "own", "prev"), "ask"), ["ask", "ring", "n"], "mean")


@query(f"WITH {TOLD_SQL} SELECT coalesce(told[1], 'neutral') AS stance, count(*) AS n FROM w GROUP BY 1")
def classify_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.one_step(answers(spark, sf_dir), "it", "answer").groupBy("stance").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WEIGHT_SQL} SELECT user_id, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean, {VAR_SQL} AS var, count(*) AS n FROM wobs GROUP BY 1, 2")
def streaming_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weighted_opinion as a stream over the files of events."""
    batch = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    k = F.col("event_type")
    obs = stream.select("user_id", (F.get_json_object("props", "$.k").cast("long") % 3).alias("issue"), F.when(k.isin("purchase", "signup"), 1).when(k == "error", -1).otherwise(0).alias("value"), (F.col("event_id") % 3).cast("int").alias("classifier_idx"))
    place = f"{shared_folder(spark)}/agora-stream-{uuid.uuid4().hex}"
    so.run_to(so.sums(obs, profiles(spark), ["user_id", "issue"]), f"{place}/sums", f"{place}/checkpoint")
    return rounded(so.opinion_of_sums(spark.read.parquet(f"{place}/sums")), "mean", "var")


@query("SELECT user_id, n, round(span / 3600.0, 4) AS hours FROM (SELECT user_id, s, count(*) AS n, max(e) - min(e) AS span FROM (SELECT user_id, e, sum(CASE WHEN e - p <= 14400 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY e, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2) WHERE n >= 3")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events at most four hours apart."""
    rows = observations(spark, sf_dir).select("user_id", "t", "comment_id")
    own = Window.partitionBy("user_id").orderBy("t", "comment_id")
    rows = rows.withColumn("s", F.sum(F.when(F.col("t") - F.lag("t").over(own) <= 14_400, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span")).where("n >= 3")
    return found.select("user_id", "n", F.round(F.col("span") / 3600.0, 4).alias("hours"))
