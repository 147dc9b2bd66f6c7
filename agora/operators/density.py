"""Clusters by density: a spanning tree of mutual reachability, condensed to clusters of a least size."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.operators import neighbours as nb
from agora.operators.forest import components, minimum_forest
from agora.sources.store import saved

NOISE = -1
#: The least distance that counts, so that the density of copies is finite.
LEAST = 1e-9
#: Most clusters of a condensed tree that the driver holds.
MOST = 100_000


def reachability(points: DataFrame, near: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n, core) and edges (a, b, w) of points (id, n) and their neighbours (query, item, d, rank).

    A point stands for n copies. Its core distance is that of its k-th neighbour, copies and
    itself counted, or of the farthest there is. An edge weighs as much as the largest of
    its length and both core distances.
    """
    order = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sizes = points.select(F.col("id").alias("item"), F.col("n").alias("m"))
    seen = near.join(sizes, "item").withColumn("seen", F.sum("m").over(order))
    own = points.select(F.col("id").alias("query"), "n")
    # The first neighbour at which the copies, itself among them, are k.
    reach = seen.join(own, "query").groupBy("query", "n").agg(F.min(F.when(F.col("seen") + F.col("n") >= k, F.col("d"))).alias("at"), F.max("d").alias("far"))
    nodes = own.join(reach.drop("n"), "query", "left").select(F.col("query").alias("node"), "n", F.when(F.col("n") >= k, F.lit(0.0)).otherwise(F.coalesce("at", "far", F.lit(0.0))).alias("core"))
    nodes = saved(nodes, "nodes")
    core = nodes.select("node", "core")
    edges = near.select(F.col("query").alias("a"), F.col("item").alias("b"), "d")
    edges = edges.join(core.withColumnsRenamed({"node": "a", "core": "ca"}), "a").join(core.withColumnsRenamed({"node": "b", "core": "cb"}), "b")
    return nodes, saved(edges.select("a", "b", F.greatest("d", "ca", "cb").alias("w")), "edges")


def _merged(size: int):
    """For applyInPandas over a piece of edges (a, b, w, ca, cb, na, nb): merges in order of (w, a, b).

    Rows of kind 0 are the edges with the sizes that they join; rows of kind 1 tell each
    component its new one, that one's size, and the edge at which it came to be of `size`.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["w", "a", "b"])
        up: dict[int, int] = {}
        count: dict[int, int] = {}
        small: dict[int, list[int]] = {}  # components that are part of none of `size` yet
        fell: dict[int, tuple] = {}
        rows = []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b, w, ca, cb, na, nb_ in part[["a", "b", "w", "ca", "cb", "na", "nb"]].itertuples(index=False):
            for c, n in ((ca, na), (cb, nb_)):
                if c not in up:
                    up[c], count[c], small[c] = c, n, [c] if n < size else []
            x, y = root(ca), root(cb)
            rows.append((0, a, b, w, count[x], count[y]))
            if len(small[x]) < len(small[y]):
                x, y = y, x
            small[x] += small.pop(y)
            up[y] = x
            count[x] += count[y]
            if count[x] >= size:
                fell.update((c, (a, b, w)) for c in small[x])
                small[x] = []
        for c in up:
            a, b, w = fell.get(c, (None, None, None))
            rows.append((1, a, b, w, c, root(c)))
            if up[c] == c:
                rows.append((2, None, None, None, c, count[c]))
        return pd.DataFrame(rows, columns=["kind", "a", "b", "w", "p", "q"]).astype({"a": "Int64", "b": "Int64"})

    return run


def merges(nodes: DataFrame, tree: DataFrame, size: int, rows: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """The single-linkage merges of a forest: edges (a, b, w, na, nb), and nodes (node, n, core, fall).

    na and nb are the points on either side when an edge joins them. fall is the edge
    (w, a, b) at which a node comes to be in a component of `size` points, null if never;
    a node of so many copies falls at its core distance.

    Edges are taken in ranges of about `rows`, lightest first; in each, every piece that
    hangs together over what lighter edges have joined is one task. So a task holds a range
    at most, and there are as many rounds as ranges.
    """
    total = tree.count()
    ranges = max(1, -(-total // rows))
    cuts = sorted(set(tree.agg(F.percentile_approx("w", [i / ranges for i in range(1, ranges)], 10_000)).first()[0])) if ranges > 1 else []
    big = F.when(F.col("n") >= size, F.struct(F.col("core").alias("w"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
    now = nodes.select("node", "n", "core", big.alias("fall"), F.col("node").alias("c"), F.col("n").cast("long").alias("size"))
    done = []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = tree.where((F.lit(True) if lo is None else F.col("w") > lo) & (F.lit(True) if hi is None else F.col("w") <= hi))
        for end, n in (("a", "na"), ("b", "nb")):
            part = part.join(now.select(F.col("node").alias(end), F.col("c").alias(f"c{end}"), F.col("size").alias(n)), end)
        part = saved(part, "range")
        if ranges == 1:
            pieces = part.withColumn("piece", F.lit(0))
        else:
            pieces = part.join(components(part.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("ca"), F.col("component").alias("piece")), "ca")
        found = saved(pieces.groupBy("piece").applyInPandas(_merged(size), "kind int, a long, b long, w double, p long, q long"), "merged")
        done.append(found.where("kind = 0").select("a", "b", "w", F.col("p").alias("na"), F.col("q").alias("nb")))
        moved = found.where("kind = 1").select(F.col("p").alias("c"), F.col("q").alias("to"), F.when(F.col("w").isNotNull(), F.struct("w", "a", "b")).alias("edge"))
        sizes = found.where("kind = 2").select(F.col("p").alias("to"), F.col("q").alias("grown"))
        now = now.join(moved.join(sizes, "to"), "c", "left").select("node", "n", "core", F.coalesce("fall", "edge").alias("fall"), F.coalesce("to", "c").alias("c"), F.coalesce("grown", "size").alias("size"))
        now = saved(now, "nodes")
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    return edges, now.select("node", "n", "core", "fall")


@dataclass
class Condensed:
    """Clusters of at least a size: parent (None for a root), the edge at which each is born out of it, and the leaf clusters' regions."""

    parent: dict[int, int | None] = field(default_factory=dict)
    born: dict[int, tuple[float, int, int] | None] = field(default_factory=dict)
    region: dict[int, int] = field(default_factory=dict)  # of a region, its leaf cluster
    roots: list[int] = field(default_factory=list)

    def spans(self) -> list[tuple]:
        """(region, cluster, lo, hi): the clusters of a region, each with the edges after lo up to hi; None is no bound."""
        out = []
        for region, leaf in self.region.items():
            lo, at = None, leaf
            while at is not None:
                out.append((region, at, lo, self.born[at]))
                lo, at = self.born[at], self.parent[at]
        return out

    def chosen(self, stability: dict[int, float]) -> dict[int, int]:
        """For each cluster the selected one that it is part of: those with more stability than all selected below them.

        A tree's root is all of it and not selected, unless there are several trees.
        """
        children: dict[int | None, list[int]] = {}
        for c, p in self.parent.items():
            children.setdefault(p, []).append(c)
        best, own = {}, set()
        for c in sorted(self.parent):  # children come before their parents
            below = sum(best[x] for x in children.get(c, []))
            alone = len(self.roots) == 1 and self.parent[c] is None
            if not alone and (c not in children or stability.get(c, 0.0) >= below):
                own.add(c)
            best[c] = stability.get(c, 0.0) if c in own else below
        out: dict[int, int] = {}
        for c in sorted(self.parent, reverse=True):
            above = out.get(self.parent[c]) if self.parent[c] is not None else None
            if above is not None:
                out[c] = above
            elif c in own:
                out[c] = c
        return out


def condense(splits: list[tuple[float, int, int, int, int]], regions: list[int]) -> Condensed:
    """The clusters of regions that edges (w, a, b, region of a, region of b) join, in order."""
    tree = Condensed()
    for i, region in enumerate(sorted(regions)):
        tree.region[region] = i
        tree.parent[i], tree.born[i] = None, None
    top = {r: c for r, c in tree.region.items()}  # by region; looked up through `up`
    up = {r: r for r in top}

    def root(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    for w, a, b, ra, rb in sorted(splits):
        x, y, new = root(ra), root(rb), len(tree.parent)
        for r in (x, y):
            tree.parent[top[r]], tree.born[top[r]] = new, (w, a, b)
        tree.parent[new], tree.born[new] = None, None
        up[y] = x
        top[x] = new
    tree.roots = [c for c, p in tree.parent.items() if p is None]
    return tree


def _density(w: Column) -> Column:
    return 1 / F.greatest(w, F.lit(LEAST))


def labels(nodes: DataFrame, tree: DataFrame, size: int, rows: int = 1 << 20) -> DataFrame:
    """(node, cluster): the density cluster of each node of a spanning forest (a, b, w), NOISE outside all.

    A merge of two sides of at least `size` points splits a cluster in two, seen from
    above; at any other merge the smaller side falls out of it. A cluster's stability is
    the sum over its points of the density (1 / w) at which they leave it less that at
    which it is born. The clusters chosen hold no other and have the largest sum. They are
    numbered by size, largest first, then by their smallest node.

    There are at most points / size clusters, which is all that the driver and a broadcast
    hold (an error beyond MOST).
    """
    edges, nodes = merges(nodes, tree, size, rows)
    both = (F.col("na") >= size) & (F.col("nb") >= size)
    split = edges.where(both)
    if split.count() > MOST:
        raise ValueError(f"over {MOST} clusters: ask for larger ones")
    # Without the splits each cluster that has no other in it is a component, with all that falls out of it or of those around it.
    parts = components(edges.where(~both))
    region = saved(nodes.where("fall is not null").join(parts, "node", "left").select("node", "n", "core", "fall", F.coalesce("component", "node").alias("region")), "regions")
    of = region.select("node", "region")
    ends = split.join(of.withColumnsRenamed({"node": "a", "region": "ra"}), "a").join(of.withColumnsRenamed({"node": "b", "region": "rb"}), "b")
    splits = [(r.w, r.a, r.b, r.ra, r.rb) for r in ends.collect()]
    regions = [r.region for r in of.select("region").distinct().collect()]
    tree_ = condense(splits, regions)
    edge = "struct<w: double, a: long, b: long>"
    spark = nodes.sparkSession
    spans = F.broadcast(spark.createDataFrame(tree_.spans(), f"region long, cluster long, lo {edge}, hi {edge}"))

    def placed(rows: DataFrame, at: str) -> DataFrame:
        """rows with the cluster that their edge `at` of their region lies in."""
        found = (F.col("lo").isNull() | (F.col(at) > F.col("lo"))) & (F.col("hi").isNull() | (F.col(at) <= F.col("hi")))
        return rows.join(spans, "region").where(found).drop("lo", "hi")

    # Every point leaves its cluster where it falls; a cluster's leave it for the one around where both are joined.
    points = saved(placed(region, "fall"), "points")
    left = points.groupBy("cluster").agg(F.sum(F.col("n") * _density(F.col("fall.w"))).alias("s"), F.sum("n").alias("n"), F.min("node").alias("first")).collect()
    stability = {r.cluster: r.s for r in left}
    count = {r.cluster: r.n for r in left}
    first = {r.cluster: r["first"] for r in left}
    for c in sorted(tree_.parent):
        if tree_.parent[c] is not None:
            p = tree_.parent[c]
            birth = 1 / max(tree_.born[c][0], LEAST)
            stability[c] = stability.get(c, 0.0) - birth * count.get(c, 0)
            # Its points are in the cluster around until that splits.
            stability[p] = stability.get(p, 0.0) + birth * count.get(c, 0)
            count[p] = count.get(p, 0) + count.get(c, 0)
    chosen = tree_.chosen(stability)
    total: dict[int, int] = {}
    least: dict[int, int] = {}
    own = {r.cluster: r.n for r in left}
    for c, s in chosen.items():
        if c in own:
            total[s] = total.get(s, 0) + own[c]
            least[s] = min(least.get(s, first[c]), first[c])
    number = {s: i for i, s in enumerate(sorted(total, key=lambda s: (-total[s], least[s])))}
    named = spark.createDataFrame([(c, number[s]) for c, s in chosen.items() if s in number], "cluster long, label int")
    found = points.select("node", "cluster").join(F.broadcast(named), "cluster").select("node", "label")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", F.lit(NOISE)).alias("cluster"))


def clusters(rows: DataFrame, key: str, embedding: str, size: int, k: int = 10, cosine: bool = False, block: int = 2048, rows_of_range: int = 1 << 20) -> DataFrame:
    """(key, cluster): the density cluster of every row, NOISE for what is in none.

    size is the least number of rows of a cluster, k of the neighbourhood that tells density.
    Equal vectors are one point with their number, named by their smallest key; keys are unique
    longs, and ties of any kind go by them, so a table has one result. Each point is tied to its k nearest, by
    an exact search; where these do not hang together, the parts are clusters of their own
    kind, as far as they have `size` rows. Rows without a vector are noise. An empty table
    gives an empty table.
    """
    v = nb.unit(embedding) if cosine else nb.clean(embedding)
    # -0.0 and 0.0 are one value.
    rows = saved(rows.select(F.col(key).alias("key"), F.transform(v, lambda x: x + F.lit(0.0)).alias("e")), "rows")
    points = rows.where("e is not null and size(e) > 0").groupBy("e").agg(F.min(F.col("key").cast("long")).alias("id"), F.count(F.lit(1)).alias("n"))
    points = saved(points.select("id", "e", "n"), "points")
    index = nb.build(points, block=block)
    near = saved(nb.nearest(index, points, k), "near")
    nodes, edges = reachability(points.drop("e"), near, k)
    tree = saved(minimum_forest(edges), "tree")
    found = labels(nodes, tree, size, rows_of_range)
    of_vector = points.select("id", "e").join(found.withColumnRenamed("node", "id"), "id").select("e", "cluster")
    return rows.join(of_vector, "e", "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
