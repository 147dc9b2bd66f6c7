"""Sources and sinks: tables that go out to the shared folder and come back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.plans.opinions import rounded
from agora.registry import query
from agora.sources import dumps, files, store
from agora.streaming import opinions as so
from agora.tables import EDGE_SQL, WEIGHT_SQL, edges, profiles, read, seconds


def place(spark: SparkSession, name: str) -> str:
    return f"{store.shared_folder(spark)}/agora-{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with ids that stay text; an unnamed index column goes."""
    path = place(spark, "csv")
    files.write_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.lit(1).alias("Unnamed: 0")), path)
    return files.read_csv(spark, path, "o_orderkey string, o_custkey string, o_orderpriority string, `Unnamed: 0` string")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "json")
    files.write_json(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")), path)
    return spark.read.schema("s_suppkey long, s_name string, s_acctbal double").json(path)


@query("SELECT o_orderstatus AS community, o_orderkey AS id, '-' AS extra FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderstatus, o_orderkey, 'zstd' FROM orders WHERE o_orderstatus <> 'P'")
def parquet_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two codecs, files with different columns, and files chosen by name and community."""
    path, rows = place(spark, "parquet"), read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("subreddit"), F.col("o_orderkey").alias("id"))
    files.write_parquet(rows, f"{path}/a", "gzip")
    files.write_parquet(rows.withColumn("extra", F.lit("zstd")), f"{path}/b", "zstd")
    found = files.scan_matching(spark, path, r"^part-\d+.*\.parquet$", ["F", "O"])
    return found.select(F.col("subreddit").alias("community"), "id", F.coalesce("extra", F.lit("-")).alias("extra"))


@query("SELECT o_orderkey AS id, o_orderstatus AS community FROM orders WHERE o_orderstatus IN ('F', 'O')")
def strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders as one table, whose columns must agree."""
    path, orders = place(spark, "strict"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("community"))
    for state in ("F", "O"):
        files.write_parquet(orders.where(F.col("community") == state), f"{path}/{state}")
    return files.scan(spark, [f"{path}/F", f"{path}/O"], loose=False)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS year_month, o_orderstatus AS subreddit, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-03' AND '1996-06' AND o_orderstatus IN ('F', 'P') GROUP BY 1, 2")
def monthly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly Parquet, pruned to months and communities."""
    path, orders = place(spark, "months"), read(spark, sf_dir, "orders")
    dumps.write_monthly(orders.select(seconds(orders, "o_orderdate").alias("created_utc"), F.col("o_orderstatus").alias("subreddit"), F.col("o_orderkey").alias("id")), path)
    found = files.scan_months(spark, path, "1995-03", "1996-06", ["F", "P"])
    return found.groupBy(F.col("year_month").cast("string").alias("year_month"), "subreddit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id AS id, turn, length(text) AS chars FROM conversations WHERE turn % 3 <> 2 AND role <> 'system'")
def zstd_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as compressed lines of JSON, read again and filtered by community and tombstone; broken lines go."""
    turns = read(spark, sf_dir, "conversations")
    body = F.when(F.col("turn") % 3 == 2, "[deleted]").otherwise(F.col("text"))
    line = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("subreddit"), body.alias("body"), F.col("turn").cast("string").alias("score")))
    lines = turns.select(F.explode(F.array(line, F.lit('{"cut": '))).alias("line"))
    path = place(spark, "dump")
    dumps.write_zstd(lines, path, frame=1 << 16)
    rows = dumps.in_scope(dumps.read_zstd(spark, path, split=1 << 16), ["user", "assistant"])
    return rows.select(F.split_part("id", F.lit("-"), F.lit(1)).cast("long").alias("id"), F.col("score").alias("turn"), F.length("body").cast("long").alias("chars"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, 'P' AS left_over FROM orders WHERE o_orderstatus IN ('F', 'O')")
def new_files_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive one after another, each read once; and which of three keys has no output yet."""
    path, orders = place(spark, "arriving"), read(spark, sf_dir, "orders")
    rows = orders.select(seconds(orders, "o_orderdate").alias("created_utc"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("subreddit"))
    for state in ("F", "O"):
        rows.where(F.col("subreddit") == state).write.mode("append").json(f"{path}/in")
        dumps.stream_json(spark, f"{path}/in", "created_utc long, id string, subreddit string", f"{path}/out", f"{path}/state")
    done = spark.read.parquet(f"{path}/out")
    left = dumps.unprocessed(orders.select(F.col("o_orderstatus").alias("subreddit")).distinct(), done.select("subreddit").distinct(), "subreddit")
    found = done.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("total"))
    return found.join(F.broadcast(left.agg(F.max("subreddit").alias("left_over"))))  # one row each


@query("SELECT k - 1 AS dim, round(avg(embedding[k]::DOUBLE), 6) + 0.0 AS mean, count(*) AS n FROM embeddings, generate_series(1, 64) g(k) GROUP BY 1")
def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as .npy files and back, joined to their keys by file and row."""
    path = place(spark, "npy")
    files.write_npy(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", path, size=300)
    rows = files.read_npy(spark, path, split=1 << 16).join(files.npy_keys(spark, path, "vec_id"), ["file", "row"]).select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return rounded(rows.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


@query(f"WITH {EDGE_SQL} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, (SELECT count(*) FROM (SELECT src FROM edge UNION SELECT dst FROM edge)) AS nodes FROM edge GROUP BY 1")
def node_link_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.operators import graph as gr

    path, rows = place(spark, "graph"), edges(spark, sf_dir).select("src", "dst", "type")
    files.node_link(rows, gr.nodes(rows), path)
    links, nodes = files.read_node_link(spark, path, "source long, target long, type string", "id long")
    found = links.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"))
    return found.join(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("nodes"))))  # one row


@query("SELECT lang, count(*) AS n, TRUE AS same FROM documents GROUP BY 1")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is made once for its settings and read after that."""
    made = []

    def make() -> DataFrame:
        made.append(1)
        return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))

    settings = {"dataset": sf_dir, "aggregation": "count", "once": uuid.uuid4().hex}
    store.cached(spark, "counts", make, **settings)
    return store.cached(spark, "counts", make, **settings).withColumn("same", F.lit(len(made) == 1))


@query("SELECT lang AS topic, source AS run, count(*) AS num_comments, round(avg(quality), 6) AS f1 FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics files in folders of runs, found again with the row counts in their names."""
    path = place(spark, "runs")
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("f1"))
    for r in rows.collect():  # a run has one file
        files.write_bytes(spark, f"{path}/{r['lang']}/{r['source']}/metrics_{r['n']}.json", json.dumps({"f1": r["f1"]}).encode())
    return rounded(files.runs(spark, path).select("topic", "run", "num_comments", "f1"), "f1")


@query(f"WITH {WEIGHT_SQL} SELECT t // 86400 AS day, issue, count(*) AS n, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean FROM wobs GROUP BY 1, 2")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of a stream of events."""
    batch = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    kind = F.col("event_type")
    obs = stream.select(F.timestamp_seconds(seconds(batch, "ts")).alias("time"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("issue"), F.when(kind.isin("purchase", "signup"), 1).when(kind == "error", -1).otherwise(0).alias("value"), (F.col("event_id") % 3).cast("int").alias("classifier_idx"))
    path = place(spark, "stream")
    so.run_to(so.windowed_sums(obs, profiles(spark), "time", "1 day", "1 hour", ["issue"]), f"{path}/sums", f"{path}/state")
    rows = so.opinion_of_sums(spark.read.parquet(f"{path}/sums"))
    return rounded(rows.select(F.floor(F.unix_seconds("window.start") / 86_400).alias("day"), "issue", "n", "mean"), "mean")


@query("WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), m AS (SELECT user_id, max(t) AS t FROM e GROUP BY 1) SELECT m.user_id, m.t, count(*) AS live FROM m JOIN e ON e.user_id = m.user_id AND e.t > m.t - 86400 GROUP BY 1, 2")
def streaming_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each user's content is not older than a day, from a state that forgets the rest."""
    batch = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", seconds(batch, "ts").alias("t"))
    path = place(spark, "stream")
    so.run_to(so.last_seen(stream, lifetime=86_400), f"{path}/live", f"{path}/state", "update")
    return spark.read.parquet(f"{path}/live")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 43200000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
SELECT user_id, min(t) AS started, max(t) + 43200000000 AS ended, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS events FROM s GROUP BY user_id, k HAVING max(t) + 43200000000 <= (SELECT max(t) // 1000 * 1000 FROM e) - 3600000000""")
def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with less than half a day between them, as far as the watermark has closed them."""
    batch = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = place(spark, "stream")
    so.run_to(so.sessions(stream, "user_id", "ts", "12 hours", "1 hour", F.sum("event_id").alias("events")), f"{path}/sessions", f"{path}/state", "append")
    rows = spark.read.parquet(f"{path}/sessions")
    return rows.select("user_id", F.unix_micros("start").alias("started"), F.unix_micros("end").alias("ended"), "n", "events")
