"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import drop, save


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id that links (a, b) reach from each linked node.

    Each round hangs neighbours on the smallest one around, first those larger than the
    node, then the rest; the links shrink to stars in a number of rounds that grows with
    the logarithm of the longest chain. Only counts and checksums reach the driver.
    """
    edges = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links", fewer=True)
    state = _state(edges)
    while state[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Now each node has its links to smaller ones as b -> a.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        new = save(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links", fewer=True)
        was, state = state, _state(new)
        drop(edges)
        edges = new
        if state == was:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
