"""Places and running sums over an order, without a task that orders a whole key.

Rows are dealt over ranges of (keys, order); a window runs inside each range, and what
the ranges before hold is added from one row for each key and range. So a key that holds
most rows is spread over many tasks. The ranges are a table in the shared folder, as they
are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.sources import store


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """rows with each of `sums` over the rows of their key up to and with themselves; totals: also <name>_all over the key."""
    spark = rows.sparkSession
    ranged = rows.withColumns({f"_v_{n}": c for n, c in sums.items()})
    ranged = ranged.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys], *order)
    ranged = store.saved(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    before = {f"_b_{n}": F.coalesce(F.sum(f"_p_{n}").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in sums}
    whole = {f"{n}_all": F.sum(f"_p_{n}").over(own) for n in sums} if totals else {}
    parts = parts.withColumns(before | whole).drop(*[f"_p_{n}" for n in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    # A null key is a key here, so the join must find it.
    same = F.lit(True)
    for k in [*keys, "_range"]:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = ranged.alias("a").join(parts.alias("b"), same)
    found = [(F.col(f"b._b_{n}") + F.coalesce(F.col(f"a._s_{n}"), F.lit(0))).alias(n) for n in sums]
    return both.select(*[F.col(f"a.`{c}`") for c in rows.columns], *found, *[F.col(f"b.{n}_all") for n in sums if totals])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place 0, 1, ... within each key, and the key's number of rows in <name>_of."""
    out = running(rows, keys, order, {name: F.lit(1).cast("long")}, totals=True)
    return out.withColumn(name, F.col(name) - 1).withColumnRenamed(f"{name}_all", f"{name}_of")
