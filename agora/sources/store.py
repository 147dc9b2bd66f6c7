"""Tables kept in a shared folder under a key made from their settings."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="agora-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again, which cuts their lineage."""
    return kept(rows, name)[0]


def kept(rows: DataFrame, name: str, by: list[str] = []) -> tuple[DataFrame, str]:  # noqa: B006
    """saved() rows, and where they lie, for tasks that read them. by: columns that make folders, so a read of some values opens their files alone."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return spark.read.schema(rows.schema).parquet(path), f"{whole.getScheme()}://{whole.getAuthority() or ''}{whole.getPath()}"


def key(**settings) -> str:
    """A short name for settings: equal settings have equal names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, name: str, make: Callable[[], DataFrame], folder: str | None = None, **settings) -> DataFrame:
    """The table of these settings: read if it is there whole, else made and written."""
    path = f"{folder or shared_folder(spark)}/{name}-{key(**settings)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
