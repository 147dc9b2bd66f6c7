"""The driver's tables as the concepts the operators work on, in Spark and in SQL.

Times are whole seconds since 1970, so no result depends on a session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Counts (classifier, true label, predicted label, n) of three classifier
# profiles: 0 perfect, 1 low precision, 2 low recall. 1 is favor, -1 against, 0 neutral.
PROFILES = [
    (0, 1, 1, 10), (0, 1, -1, 0), (0, 1, 0, 0), (0, -1, 1, 0), (0, -1, -1, 10), (0, -1, 0, 0), (0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 10),
    (1, 1, 1, 10), (1, 1, -1, 1), (1, 1, 0, 7), (1, -1, 1, 1), (1, -1, -1, 9), (1, -1, 0, 6), (1, 0, 1, 7), (1, 0, -1, 6), (1, 0, 0, 20),
    (2, 1, 1, 7), (2, 1, -1, 0), (2, 1, 0, 10), (2, -1, 1, 1), (2, -1, -1, 8), (2, -1, 0, 12), (2, 0, 1, 3), (2, 0, -1, 2), (2, 0, 0, 20),
]

PROFILE_SQL = "profile(classifier_idx, true_value, pred_value, n) AS (VALUES " + ", ".join(f"({a}, {b}, {c}, {n})" for a, b, c, n in PROFILES) + ")"

#: Observations: a user's stance (-1, 0, 1) on an issue at a time, by one of three classifiers.
OBS_SQL = """obs AS (SELECT event_id AS comment_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 3 AS issue,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS value,
  CAST(event_id % 3 AS INTEGER) AS classifier_idx, value AS raw FROM events)"""

WEIGHT_SQL = f"""{OBS_SQL}, {PROFILE_SQL},
prec AS (SELECT classifier_idx, pred_value AS value, CAST(sum(CASE WHEN true_value = pred_value THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(n), 0) AS w FROM profile GROUP BY 1, 2),
wobs AS (SELECT obs.*, prec.w FROM obs JOIN prec USING (classifier_idx, value))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})").cast("long")
    return F.unix_seconds(F.col(column))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("comment_id"),
        "user_id",
        seconds(events, "ts").alias("t"),
        "event_type",
        (F.get_json_object("props", "$.k").cast("long") % 3).alias("issue"),
        F.when(kind.isin("purchase", "signup"), 1).when(kind == "error", -1).otherwise(0).alias("value"),
        (F.col("event_id") % 3).cast("int").alias("classifier_idx"),
        F.col("value").alias("raw"),
    )


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "classifier_idx int, true_value int, pred_value int, n long")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as users, order lines as typed links; suppliers come after all customers."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").alias("src"),
        (F.col("l_suppkey") + 10_000_000).alias("dst"),
        F.col("l_returnflag").alias("type"),
        seconds(orders, "o_orderdate").alias("t") if dict(orders.dtypes)["o_orderdate"].startswith("timestamp") else F.lit(0).alias("t"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
    )


EDGE_SQL = "edge AS (SELECT o_custkey AS src, l_suppkey + 10000000 AS dst, l_returnflag AS type, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t, l_orderkey AS order_id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
