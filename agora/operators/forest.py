"""Minimum spanning forests and components of edge tables, by rounds of joins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.sources.store import saved


def _roots(parents: DataFrame) -> DataFrame:
    """(x, root) of (x, parent), where a root is its own parent: every round goes four times as far up."""
    now = saved(parents.select("x", F.col("parent").alias("root")), "parents")
    while True:
        up = now.select(F.col("x").alias("root"), F.col("root").alias("above"))
        twice = now.join(up, "root")
        up = twice.select(F.col("x").alias("above"), F.col("above").alias("top"))
        new = saved(twice.join(up, "above").select("x", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")), "parents")
        now = new.select("x", "root")
        if not new.where("moved").limit(1).count():
            return now


def minimum_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of the minimum spanning forest; ties go to smaller a, then b, with a < b.

    Borůvka: in each round every component takes its least edge, and what is joined so
    becomes one. At least half of the components go, so rounds are logarithmic. Of parallel
    edges between two components only the least stays. Least edges come by partial
    aggregation, so a node of many edges costs a row for each task.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    now = saved(edges.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("edge")), "edges")
    picked = []
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y"), "edge"))
        best = both.groupBy("x").agg(F.min(F.struct("edge", "y")).alias("m")).select("x", F.col("m.y").alias("y"), F.col("m.edge").alias("edge"))
        best = saved(best, "best")
        if not best.limit(1).count():
            break
        picked.append(best.select("edge.a", "edge.b", "edge.w").distinct())
        # Two components that take the same edge would hang on each other; the smaller one is the root.
        back = best.select(F.col("x").alias("y"), F.col("y").alias("back"))
        parents = best.join(back, "y").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("parent"))
        roots = _roots(parents)
        ends = now.join(roots, "x").select(F.col("root").alias("p"), "y", "edge")
        ends = ends.join(roots.select(F.col("x").alias("y"), F.col("root").alias("q")), "y").where("p <> q")
        now = saved(ends.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("edge").alias("edge")), "edges")
    return functools.reduce(DataFrame.unionByName, picked).distinct() if picked else edges.select("a", "b", "w")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it reaches."""
    forest = edges.select("a", "b").where("a <> b")
    now = saved(forest.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "edges")
    label = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # Each node hangs on its smallest neighbour if that is smaller than itself; such pointers have no cycle.
        parents = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("parent"))
        roots = saved(_roots(parents), "roots")
        label = roots if label is None else saved(label.join(roots.select(F.col("x").alias("root"), F.col("root").alias("up")), "root", "left").select("x", F.coalesce("up", "root").alias("root")), "label")
        ends = now.join(roots, "x").select(F.col("root").alias("p"), "y").join(roots.select(F.col("x").alias("y"), F.col("root").alias("q")), "y").where("p <> q")
        now = saved(ends.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
        if not now.limit(1).count():
            return label.select(F.col("x").alias("node"), F.col("root").alias("component"))
