"""Intermediate tables in the folder that all executors share, and gapless numbering."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="agora-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def save(df: DataFrame, name: str, fewer: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs only the tasks it was running. The tables go when the
    session ends, or earlier by drop(). fewer: for narrow tables that come from a
    shuffle and take no work, two files for each core or one for 16 partitions, where
    that is more; a task writes its partitions one after another.
    """
    spark = df.sparkSession
    if fewer:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-shuffle_partitions(spark) // 16)))
    path = f"{shared_folder(spark)}/agora-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of save() that nothing reads any more."""
    _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended, and its folder with it
            return


#: Bounds of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def whole_texts(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES from now on in its session.

    Rows hold whole texts; the usual 10 000 of them, of any size, take tens of MB outside
    the heap for each task, once on the way to Python and once on the way back. Spark has
    these bounds as settings of a session only; smaller ones that a user has set stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        size = re.fullmatch(r"(-?\d+)b?", str(now).lower())
        if size is None or not 0 < int(size[1]) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with a long column `name`: 0, 1, 2... within each group, without gaps.

    Each group is dealt over hash buckets of the order columns; rows are numbered
    within a bucket, and bucket sizes give the bucket's first number. So a group that
    holds a third of all rows still spreads over all tasks. df is read twice and
    should come from save(). Order columns that are no key leave ties in any order.
    """
    spark = df.sparkSession
    buckets = max(64, shuffle_partitions(spark))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    key = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    first = first.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("_within", within).join(first, key).withColumn(name, (F.col("_first") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_first")
