"""Operators whose results SQL does not give, against plain versions."""

import collections
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.functions import draws
from agora.operators import dynamics as dy
from agora.operators import inference as inf
from agora.operators import interactions as it
from agora.operators import landscape as la
from agora.operators import opinions as op
from agora.operators import ordered
from agora.operators import relational as rel
from agora.operators import scoring as sc
from agora.operators import stance as st
from agora.operators import topics as tp
from agora.tables import profiles


def test_running_sums_of_keys_of_any_size(spark):
    rnd = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", int(rnd.integers(0, 50)), i, float(i % 5)) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, t long, i long, x double")
    got = {r.i: (r.s, r.s_all) for r in ordered.running(frame, ["k"], [F.col("t"), F.col("i")], {"s": F.col("x")}, totals=True).collect()}
    by_key = collections.defaultdict(list)
    for r in rows:
        by_key[r[0]].append(r)
    for own in by_key.values():
        total = 0.0
        for r in sorted(own, key=lambda r: (r[1], r[2])):
            total += r[3]
            assert got[r[2]] == (total, sum(x[3] for x in own))
    places = [r.place for r in ordered.numbered(frame, [], [F.desc("t"), F.col("i")]).orderBy(F.desc("t"), "i").collect()]
    assert places == list(range(900))


def test_draws_are_the_same_in_any_partitioning(spark):
    one = spark.range(500).select("id", draws.uniform(3, "id").alias("u"), draws.normal(4, "id").alias("z"))
    two = spark.range(500).repartition(7).select("id", draws.uniform(3, "id").alias("u"), draws.normal(4, "id").alias("z"))
    assert sorted(one.collect()) == sorted(two.collect())
    u, z, p = one.select(F.avg("u"), F.stddev("z"), F.avg(draws.poisson(F.col("u")))).first()
    assert abs(u - 0.5) < 0.05 and abs(z - 1) < 0.1 and abs(p - 1) < 0.15


def test_exactly_one_raises(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert rel.exactly_one(rows, spark.createDataFrame([(1,)], "k long"), ["k"]).first().v == "a"
    for key in (2, 3):
        with pytest.raises(Exception, match="not exactly one"):
            rel.exactly_one(rows, spark.createDataFrame([(key,)], "k long"), ["k"]).collect()


def test_unknown_labels_raise(spark):
    votes = spark.createDataFrame([("s", 1, "favor"), ("s", 1, "maybe")], "k string, item long, label string")
    with pytest.raises(Exception, match="unknown label"):
        sc.label_counts(votes, ["k"], "item").collect()


def test_global_means_leave_out_first_and_last(spark):
    rnd = np.random.default_rng(2)
    content = [(i, int(rnd.integers(0, 40)), rnd.normal(size=3).tolist()) for i in range(120)]
    asks = [(100 + k, int(rnd.integers(0, 45)), 0) for k in range(25)]
    got = it.global_means(spark.createDataFrame(content, "item long, t long, e array<double>"), spark.createDataFrame(asks, "ask long, at long, z int"), "t", "item", "e", "at", 7, 3)
    for r in got.collect():
        window = sorted((c for c in content if r["at"] - 7 <= c[1] <= r["at"]), key=lambda c: (c[1], c[0]))[1:-1]
        assert r.global_n == len(window)
        assert (r.global_content is None) == (not window)
        if window:
            assert np.allclose(r.global_content, np.mean([c[2] for c in window], axis=0))


def test_hidden_markov_matches_a_plain_fit(spark):
    rnd = np.random.default_rng(3)
    rows = [(u, t, t, int(rnd.integers(-1, 2)), int(rnd.integers(0, 3)), "g") for u in range(9) for t in range(int(rnd.integers(2, 7)))]
    obs = spark.createDataFrame(rows, "user_id long, t long, comment_id long, value int, classifier_idx int, g string")
    got = {(r["from"], r["to"]): r.p for r in inf.hidden_markov(obs, profiles(spark), "g", rounds=7, tolerance=0).collect()}
    p = {(r.classifier_idx, r.pred_value, r.true_value): r.p for r in inf.row_normalized(profiles(spark)).collect()}
    seqs = collections.defaultdict(list)
    for r in sorted(rows):
        seqs[r[0]].append(np.array([p[r[4], r[3], s] for s in (-1, 0, 1)]))
    start, moves = np.full(3, 1 / 3), inf.MOVE_PRIOR / inf.MOVE_PRIOR.sum(1, keepdims=True)
    for _ in range(7):
        first, pairs = np.zeros(3), np.zeros((3, 3))
        for seq in seqs.values():
            paths = {}
            for path in np.ndindex(*[3] * len(seq)):  # every path of hidden states
                w = start[path[0]] * seq[0][path[0]]
                for i in range(1, len(seq)):
                    w *= moves[path[i - 1], path[i]] * seq[i][path[i]]
                paths[path] = w
            total = sum(paths.values())
            for path, w in paths.items():
                first[path[0]] += w / total
                for a, b in zip(path, path[1:]):
                    pairs[a, b] += w / total
        start = np.maximum(first + inf.START_PRIOR - 1, 0)
        start /= start.sum()
        moves = np.maximum(pairs + inf.MOVE_PRIOR - 1, 0)
        moves /= moves.sum(1, keepdims=True)
    for i, a in enumerate((-1, 0, 1)):
        for j, b in enumerate((-1, 0, 1)):
            assert got[a, b] == pytest.approx(moves[i, j], abs=1e-9)


def test_platforms_are_the_same_again_and_forget_what_is_old(spark):
    rows = dy.platforms(spark, 2, n=12, steps=25).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, dy.platforms(spark, 2, n=12, steps=25).repartition(5).collect()))
    posts = {(r.replica, r.id): r for r in rows if r.kind == "post"}
    comments = {(r.replica, r.id): r for r in rows if r.kind == "comment"}
    assert posts and comments and all(-1 <= r.position <= 1 for r in rows)
    for r in comments.values():
        assert 0 <= r.time - posts[r.replica, r.post_id].time < 10
        if r.parent_id is not None:
            above = comments[r.replica, r.parent_id]
            assert above.post_id == r.post_id and 0 < r.time - above.time <= 10
    edges = dy.interaction_edges(dy.platforms(spark, 2, n=12, steps=25)).collect()
    assert len(edges) == len(comments)
    assert collections.Counter(e.type for e in edges)["comment_reply"] == sum(r.parent_id is not None for r in comments.values())


def test_large_simulation_keeps_its_population(spark):
    rows = dy.simulate(spark, 40, 3).collect()
    assert collections.Counter(r.step for r in rows) == {s: 40 for s in range(4)}
    assert all(-1 <= r.position <= 1 for r in rows)
    again = dy.simulate(spark, 40, 3).collect()
    assert sorted(rows) == sorted(again)


def test_choice_weight_is_found_again(spark):
    rnd, rows = np.random.default_rng(5), []
    for k in range(3000):
        d = rnd.uniform(0.05, 2, 6)
        p = d**-1.5 / (d**-1.5).sum()
        c = rnd.choice(6, p=p)
        rows += [(k, i, float(x), int(i == c)) for i, x in enumerate(d)]
    w, error = dy.fit_choice_weight(spark.createDataFrame(rows, "k long, i int, d double, c int"), ["k"], "d", "c")
    assert abs(w - 1.5) < 4 * error < 0.3


def test_topic_models_apply_merge_and_nest(spark):
    rnd = np.random.default_rng(6)
    centers = np.array([[0, 0, 9], [0, 9, 0], [9, 0, 0], [9, 0, 1.5]])
    rows = [(i, (centers[i % 4] + rnd.normal(size=3) * 0.1).tolist(), i % 4) for i in range(200)] + [(999, [90.0, 90.0, 90.0], -1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    model = tp.fit(frame.where("vec_id < 999"), 4, reduced=None, share=1.0)
    found = {r.vec_id: r.topic for r in model.apply(frame).collect()}
    assert found.pop(999) == tp.OUTLIER
    assert len({(found[i], i % 4) for i in found}) == 4
    stays, goes, gap = model.tree()[0]
    assert {stays, goes} == {found[2], found[3]} and abs(gap - 1.5) < 0.2
    assert len(set(model.merged(3).names)) == 3 and model.merged(3).names[goes] == stays
    inner = tp.within_topics(frame, model.merged(3), 2, reduced=None, share=1.0).collect()
    assert {r.subtopic for r in inner if r.topic == stays} == {0, 1} and len(inner) == 201
    reduced = tp.fit(frame.where("vec_id < 999"), 4, reduced=2, share=1.0).apply(frame)
    assert {len(r.reduced) for r in reduced.collect()} == {2}
    assert tp.run_name(k=3, data="a/b") == "data-a-b_k-3"


def test_p_values_and_bootstrap(spark):
    rnd = np.random.default_rng(7)
    rows = [(0, k, float(x), float(3 * x + rnd.normal()), 0.0, 0.0) for k, x in enumerate(rnd.normal(size=100))] + [(1, k, float(rnd.normal()), float(rnd.normal()), 0.0, 0.0) for k in range(100)]
    frame = spark.createDataFrame(rows, "i int, k int, x double, y double, vx double, vy double")
    fits = {r.i: r for r in la.with_p_values(la.least_squares(frame, ["i"])).collect()}
    assert fits[0].p < 1e-9 and abs(fits[0].slope - 3) < 0.4 and fits[1].p > 0.001
    assert la._incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert la._incomplete_beta(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5), abs=1e-12)
    ends = {r.i: r for r in la.bootstrap(frame, ["i"], ["i", "k"], la.CORRELATION, replicates=400).collect()}
    assert ends[0].low < fits[0].r2**0.5 < ends[0].high and ends[0].low > 0.9 > ends[1].high
    # The same correction from values without one row each, and from plain draws.
    z = NormalDist()
    for i, r in ends.items():
        x, y = np.array([[b, c] for a, _, b, c, _, _ in rows if a == i]).T
        own = np.corrcoef(x, y)[0, 1]
        left = np.array([np.corrcoef(np.delete(x, k), np.delete(y, k))[0, 1] for k in range(100)])
        d = left.mean() - left
        skew = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        drawn = np.sort([np.corrcoef(x[k], y[k])[0, 1] for k in rnd.integers(0, 100, (20_000, 100))])
        bias = z.inv_cdf((drawn < own).mean())
        cuts = [np.quantile(drawn, z.cdf(bias + (bias + e) / (1 - skew * (bias + e)))) for e in (-1.96, 1.96)]
        assert r.estimate == pytest.approx(own) and (r.low, r.high) == pytest.approx(cuts, abs=0.15 * (cuts[1] - cuts[0]))
    one = la.bootstrap(frame.where("k = 1"), ["i"], ["i", "k"], la.CORRELATION).first()
    assert one.n == 1 and one.low is None and one.estimate is None
    assert la.bootstrap(frame.where("false"), ["i"], ["i", "k"], la.CORRELATION).count() == 0


def test_methods_refuse_what_they_do_not_know(spark):
    rows = spark.createDataFrame([("p", None, "c")], "post string, parent string, comment string")
    for method, prompting in (("other", "predict"), ("onestep", "other")):
        with pytest.raises(ValueError):
            st.classify(rows, method, prompting, "x", "y", "z", lambda p: p)
    sided = st.classify(rows, "twostep", "predict", "x", "y", "z", lambda p: ["yes\nagainst it"] * len(p)).first()
    assert sided.stance == "against"


def test_hashed_embeddings_are_near_for_like_texts(spark):
    rows = [(0, "the cat sat on the mat"), (1, "The cat sat on a mat"), (2, "quarterly revenue rose sharply"), (3, None), (4, "")]
    got = {r.i: r.embedding for r in tp.hashed_embedding(spark.createDataFrame(rows, "i int, t string"), "t", 256).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert dot(0, 0) == pytest.approx(1) and dot(0, 1) > 0.5 > abs(dot(0, 2))
    assert all(x == 0 for x in got[4])


def test_aggregations_by_name(spark):
    obs = spark.createDataFrame([(i, i % 3, i * 3600, i % 2, (i % 3) - 1, i % 3) for i in range(60)], "comment_id long, user_id long, t long, issue long, value int, classifier_idx int")
    op.WEIGHTS["plain"] = lambda w, days, halflife: F.lit(1.0)
    try:
        means = op.OpinionTimeline(obs, profiles(spark), "plain").window(0, 10**6)
        assert {r.user_id: r["mean"] for r in means.collect()} == {0: -1.0, 1: 0.0, 2: 1.0}
    finally:
        del op.WEIGHTS["plain"]
    for name in (*op.WEIGHTS, *op.INFERRED):
        assert op.OpinionTimeline(obs, profiles(spark), name).window(0, 10**6).count() == 6
    with pytest.raises(ValueError):
        op.OpinionTimeline(obs, profiles(spark), "other")
