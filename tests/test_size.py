"""What had failed on larger tables, held against SQL and plain versions on small ones."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agora.functions import draws
from agora.operators import dynamics as dy
from agora.operators import graph as gr
from agora.operators import interactions as it
from agora.operators import landscape as la
from agora.operators import stance as st
from agora.plans import ORACLES, QUERIES
from tests.test_queries import plain


@pytest.fixture
def made(spark, tmp_path):
    """A folder of tables, and a query's rows over it in Spark and in DuckDB."""

    def both(name: str, **tables):
        con = duckdb.connect()
        for t, frame in tables.items():
            path = f"{tmp_path}/{t}.parquet"
            con.register("frame", frame)
            times = " replace (cast(ts as timestamp) as ts)" if "ts" in frame else ""
            con.execute(f"copy (select *{times} from frame) to '{path}' (format parquet)")
            con.execute(f"create view {t} as select * from '{path}'")
        return plain(QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.execute(ORACLES[name]).df())

    return both


def events(rows) -> pd.DataFrame:
    """Events of (second since Monday 2024-01-01, user, kind, value)."""
    start = dt.datetime(2024, 1, 1)
    return pd.DataFrame([(i, start + dt.timedelta(seconds=t), u, k, float(v), f'{{"k": {i % 3}}}') for i, (t, u, k, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


def test_an_event_on_the_border_of_two_weeks_is_in_one(made):
    week = 7 * 86_400
    rows = [(t, i % 2, "click" if i % 5 else "view", 1) for i, t in enumerate([0, 0, 0, 5, 6, 7, week, week, week, week + 1, week + 2, week + 3] * 3)]
    got, want = made("timeline_attributes", events=events(rows))
    assert got == want and len(got) > 0


def test_a_bootstrap_draws_a_unit_once_and_sums_as_spark_does(spark, monkeypatch):
    made = spark.range(600).select((F.col("id") % 40).alias("unit"), (F.col("id") % 3).alias("g"), (F.col("id") % 7 / 7.0).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") % 5 + 0.5).alias("b"))
    rows = made.unionByName(made.limit(5).withColumns({"unit": F.lit(None).cast("long"), "g": F.lit(None).cast("long")}))
    want = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("w", draws.poisson(draws.uniform(3, "replicate", "unit"))).where("w > 0")
    want = want.groupBy("g", "replicate").agg(F.sum(F.col("w") * F.col("a")).alias("_s0"), F.sum(F.col("w") * F.col("b")).alias("_s1"))
    hashed = []
    monkeypatch.setattr(draws, "uniform", lambda *a: hashed.append(a) or F.lit(0.0))
    for most in (1, 512):
        got = la._resampled(rows, ["g"], ["unit"], ["a", "b"], 20, 3, most)
        both = [{(r.g, r.replicate): (r._s0, r._s1) for r in f.collect()} for f in (got, want)]
        assert both[0].keys() == both[1].keys() and len(both[0]) > 60
        assert all(both[0][k] == pytest.approx(both[1][k], abs=1e-9) for k in both[1])
    assert not hashed  # no hash for each row and replicate


def test_a_choice_of_nothing_is_made_without_a_shuffle(spark):
    rows = spark.range(300).select(F.col("id").alias("a"), F.expr("transform(slice(array(0.5D, 0D, -3D, null, 7D), 1, int(id % 6)), (x, i) -> struct(id * 10 + 9 - i AS b, x AS d))").alias("near"))
    got = dy.chosen_among(rows, ["a"], "near", "b", "d", draws.uniform(21, "a"), 5.0, 2.0)
    pairs = rows.select("a", F.inline("near")).withColumn("far", F.abs("d"))
    want = dy.choice_probabilities(dy.with_null_choice(pairs, ["a"], "b", "far", 5.0), ["a"], "far", 2.0)
    want = dy.chosen_difference(want.join(pairs.select("a", "b", "d"), ["a", "b"], "left").na.fill(0.0, ["d"]), ["a"], "b", "b", "d", draws.uniform(21, "a"), rows)
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.where("chosen <> -1").count() > 100 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def content(spark):
    """(item, user, t, key) of which one user has most, and vectors with a gap."""
    rows = spark.range(90).select(F.col("id").alias("item"), F.when(F.col("id") % 4 == 0, F.col("id") % 3).otherwise(9).alias("user"), (F.col("id") * 7 % 50).alias("t"), (F.col("id") % 5).alias("key"))
    return rows, spark.createDataFrame([(i, [float(i), i / 3 + 1]) for i in range(5)], "vec_id long, embedding array<float>")


def test_means_of_a_week_move_vectors_once_and_not_through_the_order(spark):
    rows, vectors = content(spark)
    asks = spark.range(25).select(F.col("id").alias("ask"), (F.col("id") * 3 - 4).alias("at"))
    e = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    line = sorted((r.t, r.item, r.key) for r in rows.collect())
    for block in (4, 4096):
        got = {r.ask: r for r in it.global_means(rows, asks, "t", "item", "key", "at", 10, 2, vectors, block).collect()}
        assert len(got) == 25
        for ask, r in got.items():
            inside = [x for x in line if r["at"] - 10 <= x[0] <= r["at"]][1:-1]
            assert r.global_n == len(inside)
            assert r.global_content is None if not inside else np.allclose(r.global_content, np.mean([e[x[2]] for x in inside], 0))


def test_means_before_and_after_are_the_same_in_short_stretches(spark):
    rows, vectors = content(spark)
    e = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    whole = sorted((r.user, r.t, r.item, r.key) for r in rows.collect())
    for length in (4, 1024):
        got = {r["item"]: r for r in it.before_and_after(rows, "user", ["t", "item"], "item", "key", vectors, length).collect()}
        assert len(got) == 90
        for u, t, i, _ in whole:
            own = [x for x in whole if x[0] == u]
            at = own.index((u, t, i, _))
            assert got[i].before is None if at == 0 else np.allclose(got[i].before, np.mean([e[x[3]] for x in own[:at]], 0))
            assert np.allclose(got[i].after, np.mean([e[x[3]] for x in own[at:]], 0))


def test_rings_of_many_users_are_masks_and_not_pairs(spark):
    edges = spark.range(3000).select((F.col("id") % 1500).alias("src"), ((F.col("id") * 37 + 11) % 1600).alias("dst"))
    near: dict[int, set] = {}
    for r in edges.collect():
        if r.src != r.dst:
            near.setdefault(r.src, set()).add(r.dst)
            near.setdefault(r.dst, set()).add(r.src)
    want = set()
    for user in range(1500):
        seen = last = {user}
        for k in (1, 2, 3):
            last = set().union(*[near.get(n, set()) for n in last]) - seen
            seen = seen | last
            want |= {(user, n, k) for n in last}
    starts = edges.select("src").distinct()
    masks, _ = gr.ring_masks(edges, starts)
    assert masks.count() <= 2 * 3 * 1600  # users of a chunk share a row
    assert {tuple(r) for r in gr.rings(edges, starts).collect()} == want
    sizes = pd.DataFrame(sorted(want)).groupby([0, 2]).size()
    assert {(r.user, r.ring): r.n for r in gr.ring_sizes(edges, starts).collect()} == sizes.to_dict()


def test_asking_sends_prompts_alone_to_python(spark):
    rows = spark.range(30).select("id", F.lit("p").alias("post"), F.lit(None).cast("string").alias("parent"), F.col("id").cast("string").alias("comment"))
    told = st.classify(rows, "onestep", "multichaincomparison", "a", "b", "c", lambda prompts: ["favor"] * len(prompts))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert told.where("stance = 'favor'").count() == 30
    assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") <= 2


def plain_ring_means(rows, vectors, asks, links, span):
    """{(ask, ring): (n, mean)} by loops, an average of each dimension's numbers that are not null."""
    near: dict[int, set] = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, line = {}, sorted((r.t, r.item, r.user, r.key) for r in rows)
    for ask, user, at in asks:
        inside = [x for x in line if at - span <= x[0] <= at][1:-1]
        seen = last = {user}
        for k in (1, 2, 3):
            last = set().union(*[near.get(n, set()) for n in last]) - seen
            seen = seen | last
            of = [vectors[x[3]] for x in inside if x[2] in last and vectors.get(x[3])]
            if of:
                dims = [[v[d] for v in of if d < len(v) and v[d] is not None] for d in range(2)]
                out[ask, k] = (len(of), [sum(x) / len(x) if x else None for x in dims])
    return out


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("held", [1 << 20, 400])
def test_means_of_rings_are_summed_by_author_and_not_by_pairs(spark, monkeypatch, odd, held):
    inf = float("inf")
    vectors = {k: [k / 7, 3.0 - k] for k in range(40)}
    if odd:
        vectors |= {3: [None, 1.0], 4: [inf, 2.0], 5: [-inf, float("nan")], 6: [], 7: None, 8: [1.0]}
    rows = spark.range(2000).select(F.col("id").alias("item"), (F.col("id") * 11 % 97).alias("user"), (F.col("id") * 13 % 500).alias("t"), (F.col("id") * 7 % 43).alias("key"))
    asks = spark.range(150).select((F.col("id") * 9).alias("ask"), (F.col("id") % 101).alias("user"), (F.col("id") * 4 % 520 - 5).alias("at"))
    links = spark.range(70).select((F.col("id") % 50).alias("src"), F.when(F.col("id") < 60, F.col("id") * 17 % 90).alias("dst"))
    monkeypatch.setattr(it, "HELD", held)  # the small one cuts authors and vectors into shares
    frame = spark.createDataFrame(list(vectors.items()), "key long, e array<float>")
    got = {(r.ask, r.ring): (r.n, r["mean"]) for r in it.ring_means(rows, asks, links, frame, "user", "user", "t", "item", "key", "at", 60, 2, "ask").collect()}
    e = {r.key: r.e for r in frame.collect()}
    want = plain_ring_means(rows.collect(), e, [tuple(r) for r in asks.collect()], [tuple(r) for r in links.where("dst is not null").collect()], 60)
    assert got.keys() == want.keys() and len(want) > 200
    for k in want:
        assert got[k][0] == want[k][0]
        assert got[k][1] == pytest.approx(want[k][1], abs=1e-9, nan_ok=True)


def test_neighbours_means_make_no_pairs(spark, monkeypatch):
    def pairs(*a, **b):
        raise AssertionError("pairs of users, or of asks and content, are made")

    monkeypatch.setattr(gr, "rings", pairs)
    monkeypatch.setattr(it, "circle_means", pairs)
    QUERIES["neighbour_distances"](spark, "/root/testdata/sf0.001").collect()


def test_ring_sizes_shuffle_nothing_for_an_edge_or_a_node(spark, monkeypatch):
    monkeypatch.setattr(gr.walks, "EDGES", 200)
    monkeypatch.setattr(gr.walks, "HELD_BITS", 1)  # a word for each task
    hub = spark.range(400).select(F.lit("hub").alias("src"), F.concat(F.lit("u"), "id").alias("dst"))
    some = spark.range(900).select(F.concat(F.lit("u"), F.col("id") % 300), F.concat(F.lit("v"), F.col("id") * 7 % 500))
    odd = spark.createDataFrame([("u1", "u1"), (None, "u2"), ("u3", None), ("hub", "hub")], "src string, dst string")
    edges = hub.unionByName(some.toDF("src", "dst")).unionByName(odd)
    starts = edges.select("src").distinct().unionByName(spark.createDataFrame([("alone",)], "src string"))
    near: dict[str, set] = {}
    for r in edges.where("src <> dst").collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    want = {}
    for user in (r.src for r in starts.collect() if r.src in near):
        seen = last = {user}
        for k in (1, 2, 3):
            last = set().union(*[near[n] for n in last]) - seen
            seen = seen | last
            want |= {(user, k): len(last)} if last else {}
    found = gr.ring_sizes(edges, starts)
    assert {(r.user, r.ring): r.n for r in found.collect()} == want and len(want) > 600
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
