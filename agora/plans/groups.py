"""Groups, lookups, samples and positions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import text as tx
from agora.functions.draws import uniform_sql
from agora.operators import interactions as it
from agora.operators import landscape as la
from agora.operators import relational as rel
from agora.operators.ordered import numbered
from agora.plans.opinions import rounded
from agora.plans.streams import DISTANCE_SQL, content
from agora.registry import query
from agora.tables import OBS_SQL, observations, read


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS states, count(*) AS \"count\" FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.listed(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return rows.select("o_custkey", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("orders"), F.array_join("o_orderstatus", ",").alias("states"), "count")


@query(f"WITH {OBS_SQL} SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM obs GROUP BY user_id, issue)")
def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.largest_group(observations(spark, sf_dir), ["user_id", "issue"])


BIN_SQL = "bins AS (SELECT event_type, least(CAST(floor(value * 20 / 100.0) AS BIGINT), 19) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY 1, 2)"


@query(f"WITH {BIN_SQL}, m AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS n, sum(n * ((bin + 0.5) * 5.0::DOUBLE)) / sum(n) AS mean, sum(n * power((bin + 0.5) * 5.0::DOUBLE, 2)) / sum(n) AS square, min(bin) AS first_bin, max(bin) AS last_bin FROM bins GROUP BY 1), t AS (SELECT event_type, bin FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) AS r FROM bins) WHERE r = 1) SELECT event_type, n, bin AS mode_bin, first_bin, last_bin, round(mean, 6) AS mean, round(square - mean * mean, 6) AS var FROM m JOIN t USING (event_type)")
def histogram_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = rel.histogram(read(spark, sf_dir, "events"), F.col("value"), 0.0, 100.0, 20, ["event_type"])
    return rounded(rel.histogram_moments(bins, ["event_type"], 0.0, 100.0, 20), "mean", "var")


@query(f"WITH {OBS_SQL}, s AS (SELECT user_id, count(*) AS length FROM obs GROUP BY 1), b AS (SELECT *, (row_number() OVER (PARTITION BY length ORDER BY user_id) - 1) // 4 AS batch FROM s) SELECT length, batch, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS users, count(*) AS \"count\" FROM b GROUP BY 1, 2")
def batches_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).groupBy("user_id").agg(F.collect_list("value").alias("seq"))
    return rel.by_length(rows, "seq", "user_id", 4).select("length", "batch", F.array_join(F.col("items").cast("array<string>"), ",").alias("users"), "count")


@query("SELECT label AS topic, count(*) AS n FROM embeddings GROUP BY 1")
def topic_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.operators.topics import topic_info as info

    return info(read(spark, sf_dir, "embeddings").withColumnRenamed("label", "topic"))


@query(f"WITH {DISTANCE_SQL}, e AS (SELECT d.*, event_type FROM d JOIN obs USING (comment_id)), u AS (UNPIVOT (SELECT comment_id, event_type, prev_user_euclid_dist, prev_user_cosine_sim, viewed_user_euclid_dist, viewed_user_cosine_sim FROM e) ON prev_user_euclid_dist, prev_user_cosine_sim, viewed_user_euclid_dist, viewed_user_cosine_sim INTO NAME metric VALUE value) SELECT metric, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM u GROUP BY 1, 2")
def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = it.distances(content(spark, sf_dir).where("prev is not null"), {"prev_user": ("prev", "own"), "viewed_user": ("viewed", "own")})
    metrics = [f"{p}_{k}" for p in ("prev_user", "viewed_user") for k in ("euclid_dist", "cosine_sim")]
    found = it.unpivoted(rows, ["comment_id", "event_type"], metrics).groupBy("metric", "event_type")
    return rounded(found.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


@query(f"WITH {OBS_SQL}, p AS (SELECT count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY t, comment_id) AS r, event_type FROM obs) SELECT event_type, count(*) FILTER (n >= 2 AND r > 1) AS with_previous, count(*) AS n FROM p GROUP BY 1")
def with_previous_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many interactions have a state before them."""
    rows = observations(spark, sf_dir)
    found = it.with_previous(rows, "user_id", ["t", "comment_id"], "comment_id").groupBy("event_type").agg(F.count("prev").alias("with_previous"))
    every = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "event_type", "left").select("event_type", F.coalesce("with_previous", F.lit(0)).alias("with_previous"), "n")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM documents")
def by_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return numbered(docs, [], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "place")


@query(f"SELECT doc_id, quality, row_number() OVER (ORDER BY {uniform_sql(3, 'doc_id')}, doc_id) - 1 AS place FROM labels")
def shuffled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.shuffled(read(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], 3)


@query(f"WITH p AS (SELECT vec_id, label, (SELECT count(*) FROM generate_series(0, 63) g(i) WHERE {uniform_sql(5, 'vec_id', 'i')} < 0.25 / 64) AS n FROM embeddings) SELECT vec_id, label, k AS copy FROM p, generate_series(1, 64) c(k) WHERE k <= n")
def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = rel.sample_again(read(spark, sf_dir, "embeddings").select("vec_id", "label"), ["vec_id"], 0.25, 5)
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("label")).cast("long"))


@query(f"WITH {OBS_SQL} SELECT comment_id, user_id FROM obs WHERE user_id IN (SELECT DISTINCT user_id FROM obs WHERE {uniform_sql(7, 'user_id')} < 0.3)")
def user_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return rel.of_sample(rows, rows, "user_id", 0.3, 7).select("comment_id", "user_id")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {uniform_sql(9, 'o_orderkey')} < 0.1)")
def comments_of_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return rel.of_sample(lines, orders, "l_orderkey", 0.1, 9).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, p_name AS description FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def described_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("description"))
    return lines.join(part, "l_partkey", "left").select("l_orderkey", "l_linenumber", "description")


@query("SELECT doc_id, lang, quality, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents JOIN labels USING (doc_id)")
def annotated_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    places = numbered(labels, [], [F.col("doc_id")]).drop("place_of")
    return rel.in_order(read(spark, sf_dir, "documents"), places, "doc_id", ["lang"], "place").select("doc_id", "lang", "quality", "place")


@query("SELECT d.doc_id, e.vec_id, e.label FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d JOIN (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings) e USING (r)")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rel.zipped(docs, vectors, [F.col("doc_id")], [F.col("vec_id")]).select("doc_id", "vec_id", "label")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def exactly_one_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    found = rel.exactly_one(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), asks, ["o_orderkey"])
    return found.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_orderstatus")


@query(f"WITH {OBS_SQL} SELECT a.comment_id, coalesce(b.comment_id, -1) AS last_comment_id, b.event_type AS last_event_type FROM (SELECT * FROM obs WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, t, max(comment_id) AS comment_id, max_by(event_type, comment_id) AS event_type FROM obs WHERE event_type <> 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.t >= b.t")
def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last other event of a user at or before each purchase."""
    rows = observations(spark, sf_dir)
    asks = rows.where("event_type = 'purchase'").select("comment_id", "user_id", F.col("t").alias("at"))
    found = rel.latest(asks, rows.where("event_type <> 'purchase'"), ["user_id"], "at", "t", ["comment_id"], ["comment_id", "event_type"])
    return found.select("comment_id", F.coalesce("last_comment_id", F.lit(-1)).alias("last_comment_id"), "last_event_type")


@query("SELECT kind, count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'comment' AS kind, conv_id || ':' || turn AS id, text FROM conversations UNION ALL SELECT 'submission', CAST(doc_id AS VARCHAR), text FROM documents) GROUP BY 1")
def stacked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, docs = read(spark, sf_dir, "conversations"), read(spark, sf_dir, "documents")
    rows = rel.stacked({"comment": (turns, F.concat_ws(":", "conv_id", "turn"), F.col("text")), "submission": (docs, F.col("doc_id"), F.col("text"))})
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.length("text")).alias("chars"))


@query("SELECT NOT EXISTS (SELECT doc_id, quality FROM labels EXCEPT ALL SELECT doc_id, quality FROM labels) AS same, FALSE AS other")
def same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is the same as itself in another order, and not as itself with one label more."""
    rows = read(spark, sf_dir, "labels").select("doc_id", "quality")
    other = rel.same_rows(rows, rows.unionByName(rows.orderBy("doc_id").limit(1))).withColumnRenamed("same", "other")
    return rel.same_rows(rows, rows.orderBy(F.desc("doc_id"))).join(F.broadcast(other))  # one row each


@query("SELECT vec_id, label, FALSE AS again FROM embeddings UNION ALL SELECT vec_id + (SELECT max(vec_id) + 1 FROM embeddings), label, TRUE FROM embeddings")
def row_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rel.row_concat([rows.withColumn("again", F.lit(False)), rows.withColumn("again", F.lit(True))], "vec_id")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def without_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.without_columns(read(spark, sf_dir, "nation"), "key$").join(read(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "n_name").toDF("name", "region")


#: Conversations as a thread: ids, authors, permalinks and parents.
THREAD_SQL = """turns AS (SELECT 'c' || conv_id || 'x' || turn AS id, conv_id * 10 + turn % 3 AS author, text AS body, '/r/s/comments/p' || conv_id || '/title/' || turn || '/' AS permalink, CASE WHEN turn = 0 THEN 't3_p' || conv_id ELSE 't1_c' || conv_id || 'x' || (turn - 1) END AS parent_id FROM conversations),
posts AS (SELECT '/r/s/comments/p' || conv_id || '/title/' AS permalink, 'Title ' || conv_id AS title FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 > 0))"""


@query(f"WITH {THREAD_SQL} SELECT c.id, p.title, contains(c.parent_id, 't3_') AS is_base_comment, regexp_extract(c.parent_id, '^t[0-9]_([a-z0-9]*)', 1) AS parent_specific_id, coalesce(b.author, -1) AS author_parent, coalesce(length(b.body), -1) AS parent_chars FROM turns c LEFT JOIN posts p ON p.permalink = regexp_extract(c.permalink, '^(/[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/)', 1) LEFT JOIN turns b ON b.id = regexp_extract(c.parent_id, '^t[0-9]_([a-z0-9]*)', 1)")
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    rows = turns.select(
        F.concat(F.lit("c"), conv, F.lit("x"), turn).alias("id"),
        (F.col("conv_id") * 10 + F.col("turn") % 3).alias("author"),
        F.col("text").alias("body"),
        F.concat(F.lit("/r/s/comments/p"), conv, F.lit("/title/"), turn, F.lit("/")).alias("permalink"),
        F.when(F.col("turn") == 0, F.concat(F.lit("t3_p"), conv)).otherwise(F.concat(F.lit("t1_c"), conv, F.lit("x"), (F.col("turn") - 1).cast("string"))).alias("parent_id"),
    )
    posts = turns.where("conv_id % 3 > 0").select("conv_id").distinct().select(F.concat(F.lit("/r/s/comments/p"), conv, F.lit("/title/")).alias("permalink"), F.concat(F.lit("Title "), conv).alias("title"), F.lit(None).cast("string").alias("selftext"))
    found = rel.parents(rows, posts, tx.post_permalink(F.col("permalink")), F.col("parent_id"))
    return found.select("id", "title", "is_base_comment", "parent_specific_id", F.coalesce("author_parent", F.lit(-1)).alias("author_parent"), F.coalesce(F.length("body_parent"), F.lit(-1)).cast("long").alias("parent_chars"))


RUN_SQL = "run AS (SELECT lang, source, quality, count(*) AS num_docs, avg(toxic) AS metric FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3)"


@query(f"WITH {RUN_SQL} SELECT lang, source, num_docs, round(metric, 4) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(metric, 4) DESC, num_docs DESC, source, quality) AS r FROM run WHERE round(metric, 4) > 0) WHERE r = 1")
def best_run_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "source", "quality")
    runs = runs.agg(F.count(F.lit(1)).alias("num_docs"), F.avg("toxic").alias("metric"))
    # Equal in both: the first by name.
    order = numbered(runs, [], [F.desc("source"), F.desc("quality")], "name_rank").withColumn("ties", F.struct("num_docs", "name_rank"))
    return rel.best_in_steps(order, ["lang"], "metric", "ties").select("lang", "source", "num_docs", F.round("metric", 4).alias("metric"))


@query(f"WITH {RUN_SQL} SELECT quality AS label, round(max(best), 6) AS best, round(avg(best), 6) AS mean, count(*) AS n FROM (SELECT lang, quality, max(metric) AS best FROM run GROUP BY 1, 2) GROUP BY 1")
def best_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "source", "quality").agg(F.avg("toxic").alias("metric"))
    return rounded(rel.best_by_class(runs, ["lang"], "quality", "metric").withColumnRenamed("quality", "label"), "best", "mean")


FIVE_SQL = f"{OBS_SQL}, five AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS issue, round(avg(raw) / 100, 6) AS b FROM obs GROUP BY 1, 2)"
_PARTS = [(k, i) for k, block in enumerate(la.two_blocks([0, 1, 2, 3, 4])) for i in block]


@query(f"""WITH {FIVE_SQL}, part(part, issue) AS (VALUES {', '.join(map(str, _PARTS))}), y AS (SELECT part, user_id, avg(b) AS y FROM five JOIN part USING (issue) GROUP BY 1, 2),
s AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY y, user_id) AS i, sum(y) OVER (PARTITION BY part ORDER BY y, user_id ROWS UNBOUNDED PRECEDING) AS low, count(*) OVER (PARTITION BY part) AS n, sum(y) OVER (PARTITION BY part) AS tot FROM y),
p AS (SELECT CAST(part AS INTEGER) AS part, round(max((i * (tot - low) - (n - i) * low) / (4.0 * n * n)), 6) + 0.0 AS polarization FROM s GROUP BY 1)
SELECT * FROM (SELECT 'most' AS kind, part, polarization FROM p ORDER BY polarization DESC, part LIMIT 5) UNION ALL SELECT * FROM (SELECT 'least', part, polarization FROM p ORDER BY polarization, part LIMIT 5)""")
def polarized_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most and the five least polarized partitions of five kinds of events."""
    names = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup")])
    issue = F.when(F.array_contains(names, F.col("event_type")), F.array_position(names, F.col("event_type")) - 1).otherwise(4)
    rows = observations(spark, sf_dir).groupBy("user_id", issue.cast("int").alias("issue")).agg(F.round(F.avg("raw") / 100, 6).alias("b"))
    parts = rounded(la.asymmetric_polarization(rows, [0, 1, 2, 3, 4]), "polarization")
    most = parts.orderBy(F.desc("polarization"), "part").limit(5).select(F.lit("most").alias("kind"), "part", "polarization")
    return most.unionByName(parts.orderBy("polarization", "part").limit(5).select(F.lit("least").alias("kind"), "part", "polarization"))
