"""Neighbours, forests and density clusters against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import density, forest, reduction
from agora.operators import neighbours as nb


def blobs(seed, centers=6, each=60, noise=80, dims=3):
    rnd = np.random.default_rng(seed)
    parts = [rnd.normal(rnd.uniform(-12, 12, dims), rnd.uniform(0.2, 1.2), (each + 10 * i, dims)) for i in range(centers)]
    return np.vstack([*parts, rnd.uniform(-15, 15, (noise, dims))]).round(6)


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, e array<double>").repartition(parts)


def exact(x, k, queries=None):
    out = {}
    for i in range(len(x)) if queries is None else queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(12)
        d[i] = np.inf
        out[i] = [(int(j), d[j]) for j in np.lexsort((np.arange(len(x)), d))[:k] if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("block", [20, 64, 4096])
def test_neighbours_are_exact(spark, block):
    x = blobs(1)
    x[5:60:5] = x[0]  # copies, and ties
    index = nb.build(frame(spark, x), block=block)
    got = {}
    for r in nb.nearest(index, frame(spark, x), 7, probes=2).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.item, r.d))
    assert got == exact(x, 7)


def test_clustered_queries_ask_few_lists(spark):
    """With clusters, what is met grows with the rows: most pairs of query and list are left out."""
    x = blobs(2, centers=40, each=100, noise=0, dims=8)
    index = nb.build(frame(spark, x), block=64)
    asked = index.rows.sparkSession.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, len(x), 100)], "id long, e array<double>")
    found = nb.nearest(index, asked, 5)
    want = exact(x, 5, range(0, len(x), 100))
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.item, r.d))
    assert got == want
    d = nb.distances(x[::100], index.pivots)
    kth = np.array([want[i][-1][1] for i in range(0, len(x), 100)])[:, None]
    open_ = np.maximum.reduce([d - index.farthest, index.nearest - d, (d - d.min(1, keepdims=True)) / 2]) <= kth
    assert open_.mean() < 0.15 and len(index.pivots) > 50


def test_few_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None)], "id long, e array<double>")
    got = nb.nearest(nb.build(rows), rows, 5).collect()
    assert sorted((r.query, r.item, r.d, r.rank) for r in got) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    none = rows.where("false")
    assert nb.nearest(nb.build(none), none, 5).count() == 0
    odd = spark.createDataFrame([(1, [float("nan"), None, 3.0]), (2, [0.0, 0.0])], "id long, e array<double>")
    assert [r.u for r in odd.orderBy("id").select(nb.unit("e").alias("u")).collect()] == [[0.0, 0.0, 1.0], [0.0, 0.0]]


def kruskal(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    kept = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        if root(a) != root(b):
            up[root(a)] = root(b)
            kept.append((a, b, w))
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_forest(spark, seed):
    rnd = np.random.default_rng(seed)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rnd.integers(0, 90, 240), rnd.integers(0, 120, 240), rnd.integers(0, 9, 240))]
    edges += [(500 + i, 501 + i, float(40 - i)) for i in range(40)] + [(900, i, 1.0) for i in range(700, 760)] + [(7, 7, 0.0)]
    table = spark.createDataFrame(edges, "a long, b long, w double")
    want = kruskal(edges)
    assert sorted(map(tuple, forest.minimum_forest(table).collect())) == sorted(want)
    label = {}
    for a, b, _ in want:
        old = {label.get(a, a), label.get(b, b)}
        label = {**label, a: label.get(a, a), b: label.get(b, b)}
        label = {x: min(old) if c in old else c for x, c in label.items()}
    assert {r.node: r.component for r in forest.components(table).collect()} == label
    none = table.where("false")
    assert forest.minimum_forest(none).count() == forest.components(none).count() == 0


def plain_clusters(x, size, k):
    """Top-down: cut the heaviest edge again and again, and let parts smaller than `size` fall."""
    points, at, n = np.unique(x, axis=0, return_index=True, return_counts=True)
    order = np.argsort(at)  # points in order of their smallest key
    points, n = points[order], n[order]
    first = {tuple(p): i for i, p in enumerate(points)}
    near = exact(points, k)
    core = {}
    for i, found in near.items():
        seen, core[i] = n[i], 0.0
        for j, d in found:
            if seen >= k:
                break
            seen, core[i] = seen + n[j], d
    tree = kruskal([(i, j, max(d, core[i], core[j])) for i, found in near.items() for j, d in found])

    def parts(nodes, edges):
        up = {v: v for v in nodes}

        def root(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b, _ in edges:
            up[root(a)] = root(b)
        out = {}
        for v in nodes:
            out.setdefault(root(v), []).append(v)
        return [(vs, [e for e in edges if root(e[0]) == root(vs[0])]) for vs in out.values()]

    weight = lambda nodes: sum(n[v] for v in nodes)
    density_of = lambda w: 1 / max(w, density.LEAST)

    def cluster(nodes, edges, birth):
        """(stability, own points, children) of a cluster born at a density."""
        left, stability, fallen = (nodes, sorted(edges, key=lambda e: (e[2], e[0], e[1]))), 0.0, []
        while True:
            nodes, edges = left
            if not edges:  # a point of many copies
                stability += weight(nodes) * (density_of(core[nodes[0]]) - birth)
                return stability, fallen + nodes, []
            w = edges[-1][2]
            two = parts(nodes, edges[:-1])
            large = [p for p in two if weight(p[0]) >= size]
            for p in two:
                if p not in large:
                    stability += weight(p[0]) * (density_of(w) - birth)
                    fallen += p[0]
            if len(large) == 2:
                stability += weight(nodes) * (density_of(w) - birth)
                return stability, fallen, [cluster(*p, density_of(w)) for p in large]
            if not large:
                return stability, fallen, []
            left = (large[0][0], sorted(large[0][1], key=lambda e: (e[2], e[0], e[1])))

    roots = [cluster(*p, 0.0) for p in parts(range(len(points)), tree) if weight(p[0]) >= size]
    members = lambda c: c[1] + list(itertools.chain(*map(members, c[2])))

    def choose(c, selectable=True):
        below = [choose(x) for x in c[2]]
        total = sum(b[0] for b in below)
        if selectable and (not c[2] or c[0] >= total):
            return c[0], [members(c)]
        return total, list(itertools.chain(*(b[1] for b in below)))

    chosen = list(itertools.chain(*(choose(r, len(roots) > 1)[1] for r in roots)))
    label = {v: i for i, c in enumerate(chosen) for v in c}
    return [label.get(first[tuple(p)], -1) for p in x]


def same_partition(got, want):
    assert [g == -1 for g in got] == [w == -1 for w in want]
    assert len({*zip(got, want)}) == len({*got}) == len({*want})


@pytest.mark.parametrize("seed,size,k,copies,ranges", [(1, 25, 10, 0, 1 << 20), (2, 12, 5, 40, 1 << 20), (3, 12, 5, 15, 200)])
def test_clusters(spark, seed, size, k, copies, ranges):
    x = blobs(seed)
    x[:copies] = x[0]
    rows = frame(spark, x).withColumn("n", F.lit("x"))
    more = rows.unionByName(spark.createDataFrame([(-5, None, "x"), (-6, [], "x")], "id long, e array<double>, n string"))
    got = {r.id: r.cluster for r in density.clusters(more, "id", "e", size, k, block=64, rows_of_range=ranges).collect()}
    assert got.pop(-5) == got.pop(-6) == -1
    want = plain_clusters(x, size, k)
    same_partition([got[i] for i in range(len(x))], want)
    assert len({*want}) > 3
    sizes = [sum(g == c for g in got.values()) for c in range(max(got.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True)
    assert density.clusters(rows.where("false"), "id", "e", size, k).count() == 0


def test_the_least_of_a_row_are_those_of_a_stable_sort():
    rnd = np.random.default_rng(3)
    d = rnd.integers(0, 9, (200, 40)).astype(float)  # with many ties
    for k in (1, 6, 16, 30, 50):
        assert (nb.smallest(d, k) == np.argsort(d, 1, kind="stable")[:, :k]).all()


def test_a_reduction_brings_its_sums_in_one_job(spark):
    """Sums of landmarks came by a job for each shuffle partition that was left."""
    x = np.random.default_rng(4).normal(size=(300, 6))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    spark.sparkContext.setJobGroup("reduction", "")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        reduction.fit(frame(spark, x).select("id", "e"), 3, "id", "e", landmarks=40)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("reduction")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 12
