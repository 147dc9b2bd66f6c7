"""Activity, threads, samples, histograms and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import text as tx
from agora.functions.draws import uniform_sql
from agora.operators import relational as rel
from agora.plans.opinions import rounded
from agora.registry import query
from agora.tables import OBS_SQL, observations, read

STATS_SQL = f"{OBS_SQL}, stats AS (SELECT user_id, count(comment_id) AS n, min(t) AS first, max(t) AS last, round((max(t) - min(t)) / 86400.0, 6) AS days FROM obs WHERE user_id IS NOT NULL GROUP BY 1)"


@query(f"WITH {STATS_SQL} SELECT * FROM stats")
def author_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rel.author_stats(observations(spark, sf_dir), "user_id", "t", "comment_id"), "days")


@query(f"WITH {OBS_SQL} SELECT user_id, count(*) FILTER (issue = 0) AS i0, count(*) FILTER (issue = 1) AS i1, count(*) FILTER (issue = 2) AS i2 FROM obs GROUP BY 1")
def author_topic_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = observations(spark, sf_dir).groupBy("user_id").pivot("issue", [0, 1, 2]).count().na.fill(0)
    return wide.withColumnsRenamed({"0": "i0", "1": "i1", "2": "i2"})


@query(f"WITH {STATS_SQL}, topic AS (SELECT user_id, count(*) FILTER (issue IN (0, 2)) AS on_topic, count(DISTINCT issue) FILTER (issue IN (0, 2)) AS topics FROM obs GROUP BY 1) SELECT user_id, n, days, on_topic, topics FROM stats LEFT JOIN topic USING (user_id) WHERE on_topic >= 40 AND days >= 10")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    stats = rounded(rel.author_stats(obs, "user_id", "t", "comment_id"), "days")
    both = stats.join(rel.topic_activity(obs, "user_id", "issue", [0, 2]), "user_id", "left")
    return rel.active_users(both, "on_topic", 40, "days", 10).select("user_id", "n", "days", "on_topic", "topics")


@query(f"WITH {OBS_SQL} SELECT comment_id, user_id, issue FROM obs WHERE user_id IN (SELECT user_id FROM obs GROUP BY 1 HAVING count(comment_id) > 60)")
def active_user_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.of_active(observations(spark, sf_dir), "user_id", "comment_id", 60).select("comment_id", "user_id", "issue")


@query("WITH t AS (SELECT *, CASE WHEN turn > 0 THEN turn - 1 END AS parent FROM conversations) SELECT a.conv_id, a.turn, coalesce(a.parent, -1) AS parent, b.role AS role_parent, coalesce(length(b.text), 0) AS parent_chars, a.turn = 0 AS is_base FROM t a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.parent = b.turn")
def thread_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1))
    rows = rel.with_parents(turns, ["conv_id"], "parent", "turn", ["role", "text"])
    return rows.select("conv_id", "turn", F.coalesce("parent", F.lit(-1)).alias("parent"), "role_parent", F.coalesce(F.length("text_parent"), F.lit(0)).cast("long").alias("parent_chars"), (F.col("turn") == 0).alias("is_base"))


@query("WITH t AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 2 END AS parent FROM conversations) SELECT conv_id, turn, coalesce(parent, -99) AS parent FROM t WHERE parent IS NULL OR EXISTS (SELECT 1 FROM t o WHERE o.conv_id = t.conv_id AND o.turn = t.parent)")
def orphan_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 2).alias("parent"))
    return rel.without_orphans(turns, ["conv_id"], "parent", "turn").select("conv_id", "turn", F.coalesce("parent", F.lit(-99)).alias("parent"))


@query("SELECT l_orderkey AS thread, l_linenumber AS item, l_suppkey AS author FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > 640))")
def active_thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread"), F.col("l_linenumber").alias("item"), F.col("l_suppkey").alias("author"))
    active = lines.groupBy("author").count().where("count > 640").select("author")
    return rel.thread_context(lines, "thread", "author", active).select("thread", "item", "author")


@query("SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def user_counts_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    right = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return rel.outer_counts(left, right, "nation", ("customers", "suppliers"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def submission_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.first_by(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"WITH {OBS_SQL} SELECT user_id, comment_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, comment_id DESC) AS rank FROM obs) WHERE rank <= 3")
def topk_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("t").desc(), F.col("comment_id").desc()]
    return rel.top_k(observations(spark, sf_dir), ["user_id"], order, 3).select("user_id", "comment_id", "rank")


@query(f"WITH {OBS_SQL} SELECT user_id, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, comment_id) AS r FROM obs) WHERE r % 5 = 1")
def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.every_kth(observations(spark, sf_dir), ["user_id"], [F.col("t"), F.col("comment_id")], 5).select("user_id", "comment_id")


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CAST(CASE WHEN i <= floor(0.7 * n) THEN 0 WHEN i <= floor(0.7 * n) + floor(0.2 * n) THEN 1 ELSE 2 END AS INTEGER) AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.stratified_split(read(spark, sf_dir, "labels"), "quality", [F.col("doc_id")], (0.7, 0.2)).select("doc_id", "quality", "split")


@query(f"SELECT event_id, user_id FROM events WHERE {uniform_sql(0, 'event_id')} < 0.2")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.hash_sample(read(spark, sf_dir, "events"), ["event_id"], 0.2).select("event_id", "user_id")


@query("WITH b AS (SELECT least(CAST(floor((value - 0.0) * 20 / 100.0) AS BIGINT), 19) AS bin FROM events WHERE value >= 0 AND value <= 100), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1) SELECT bin, n, round(n / (sum(n) OVER () * 5.0), 6) AS density FROM c")
def hist1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rel.histogram(read(spark, sf_dir, "events"), F.col("value"), 0.0, 100.0, 20), "density")


@query("WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_custkey) AS c, max(o_custkey) AS d FROM orders) SELECT least(CAST(floor((o_totalprice - a) * 10 / (b - a)) AS BIGINT), 9) AS x_bin, least(CAST(floor((o_custkey - c) * 10 / CAST(d - c AS DOUBLE)) AS BIGINT), 9) AS y_bin, count(*) AS n FROM orders, e GROUP BY 1, 2")
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.histogram_2d(read(spark, sf_dir, "orders").select("o_totalprice", "o_custkey"), "o_totalprice", "o_custkey", 10)


@query("WITH c AS (SELECT CAST(least(floor(log10(n_chars) * 20), 119) AS BIGINT) AS bin FROM documents WHERE n_chars >= 1 AND log10(n_chars) <= 6) SELECT bin, count(*) AS n FROM c GROUP BY 1")
def log_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.histogram(read(spark, sf_dir, "documents").where("n_chars >= 1"), F.log10("n_chars"), 0.0, 6.0, 120).select("bin", "n")


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL AND text NOT IN ('', 'Nan', 'Null') AND lang = 'en' GROUP BY 1, 2")
def text_sentinel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where(~tx.is_sentinel(F.col("text")) & ~tx.is_blank(F.col("text")) & (F.col("lang") == "en"))
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT p_partkey, replace(replace(p_type, ' ', '_'), '/', '_') AS slug, CASE WHEN length(p_name) < 30 THEN p_name ELSE concat(left(p_name, 30), '...') END AS short, concat(p_name, ': ', p_brand) AS title FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", tx.slug(F.col("p_type")).alias("slug"), tx.shortened(F.col("p_name")).alias("short"), F.concat("p_name", F.lit(": "), "p_brand").alias("title"))


@query(r"SELECT conv_id, turn, md5(concat(regexp_replace(replace(text, chr(10), ' '), '(.{100}[^ ]*) ', '\1' || chr(10), 'g'), chr(10))) AS wrapped FROM conversations")
def wrap_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.md5(tx.wrapped(tx.one_line(F.col("text"))).cast("binary")).alias("wrapped"))


@query("""WITH t AS (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS post, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN turn = 0 THEN concat('Post: ', text) WHEN turn = 1 THEN concat('Post: ', post, chr(10), 'Comment: ', text) ELSE concat('Post: ', post, chr(10), 'Parent comment: ', parent, chr(10), 'Comment: ', text) END) AS prompt FROM t""")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumn("post", F.first("text").over(order)).withColumn("parent", F.lag("text").over(order))
    made = tx.prompt(F.col("turn") > 0, F.col("turn") > 1, F.col("post"), F.col("parent"), F.col("text"))
    return turns.select("conv_id", "turn", F.md5(made.cast("binary")).alias("prompt"))


#: Answers of every telling kind before the text of each document.
ANSWER_SQL = "CASE doc_id % 6 WHEN 0 THEN 'I strongly agree.' WHEN 1 THEN 'They disagree with it' WHEN 2 THEN 'Neutral, I think' WHEN 3 THEN 'against' || chr(10) || 'favor' WHEN 4 THEN 'No idea' ELSE 'Yes, in FAVOR of it' END || ' ' || coalesce(text, '')"
TOLD_SQL = f"""a AS (SELECT doc_id, {ANSWER_SQL} AS answer FROM documents), l AS (SELECT doc_id, lower(split_part(answer, chr(10), 1)) AS line, lower(answer) AS low FROM a), w AS (SELECT doc_id, low, list_filter(list_transform(regexp_extract_all(line, '(\\w+)'), lambda x: CASE WHEN contains(x, 'favor') OR contains(x, 'support') OR (contains(x, 'agree') AND NOT contains(x, 'disagree')) THEN 'favor' WHEN contains(x, 'against') OR contains(x, 'disagree') THEN 'against' WHEN contains(x, 'neutral') THEN 'neutral' END), lambda x: x IS NOT NULL) AS told FROM l)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["I strongly agree.", "They disagree with it", "Neutral, I think", "against\nfavor", "No idea", "Yes, in FAVOR of it"]
    answer = F.concat(F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"))


@query(f"WITH {TOLD_SQL} SELECT doc_id, coalesce(told[1], 'neutral') AS stance, CASE WHEN contains(low, 'yes') THEN 'yes' ELSE 'no' END AS yes_no FROM w")
def parse_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = answers(spark, sf_dir)
    return docs.select("doc_id", tx.parse_stance(F.col("answer")).alias("stance"), tx.parse_yes_no(F.col("answer")).alias("yes_no"))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS number FROM pages WHERE regexp_matches(url, '^https?://[^/]+/([a-z]+)/')")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    rows = read(spark, sf_dir, "pages").select("page_id", tx.extract(url, r"^https?://[^/]+/([a-z]+)/").alias("lang"), tx.extract(url, r"/([0-9]+)").cast("int").alias("number"))
    return rows.where("lang is not null")


@query("WITH r AS (SELECT source, lang, count(*) AS num_docs, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS metric FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT lang, source, num_docs, round(metric, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(metric, 6) DESC, num_docs DESC, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER)) AS k FROM r WHERE metric > 0 AND num_docs >= 2) WHERE k = 1")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source", "lang")
    runs = rounded(runs.agg(F.count(F.lit(1)).alias("num_docs"), F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("metric")), "metric")
    # Equal in both, the first source by name.
    runs = runs.withColumn("ties", F.struct("num_docs", -F.regexp_extract("source", r"(\d+)", 1).cast("int")))
    found = rel.best_run(runs, ["lang"], "metric", "ties", F.col("num_docs") >= 2)
    return found.select("lang", "source", "num_docs", "metric")


@query(f"WITH {OBS_SQL} SELECT user_id, comment_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, comment_id DESC) AS r FROM obs) WHERE r = 2")
def previous_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second most recent content of each user."""
    order = [F.col("t").desc(), F.col("comment_id").desc()]
    return rel.top_k(observations(spark, sf_dir), ["user_id"], order, 2).where("rank = 2").select("user_id", "comment_id", "event_type")


@query(f"WITH {OBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, comment_id) AS r FROM obs) SELECT comment_id, user_id, CASE WHEN r <= 10 THEN 'train' WHEN r <= 20 THEN 'dev' ELSE 'test' END AS part FROM r")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first ten rows to train, the next ten to tune, the rest to test."""
    rows = rel.top_k(observations(spark, sf_dir), ["user_id"], [F.col("t"), F.col("comment_id")], 2**31 - 1)
    part = F.when(F.col("rank") <= 10, "train").when(F.col("rank") <= 20, "dev").otherwise("test")
    return rows.select("comment_id", "user_id", part.alias("part"))


@query(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {uniform_sql(3, 'o_orderkey')}, o_orderkey LIMIT 50")
def fixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders, those of smallest hash."""
    return rel.fixed_sample(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 50, 3)
