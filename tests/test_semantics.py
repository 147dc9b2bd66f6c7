"""Nulls, ties and bounds, on small tables."""

import pytest
from pyspark.sql import functions as F

from agora.functions import text as tx
from agora.functions import vectors as vec
from agora.operators import dynamics as dy
from agora.operators import graph as gr
from agora.operators import landscape as la
from agora.operators import opinions as op
from agora.operators import relational as rel
from agora.operators import scoring as sc
from agora.tables import profiles


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_no_match_is_null_and_an_empty_group_is_empty(spark):
    assert one(spark, tx.bare_id(F.lit("t1_abc"))) == "abc"
    assert one(spark, tx.bare_id(F.lit("t1_"))) == ""
    assert one(spark, tx.bare_id(F.lit("x"))) is None
    assert one(spark, tx.post_permalink(F.lit("/r/a/comments/b/c/d/"))) == "/r/a/comments/b/c/"


def test_text_of_parts(spark):
    assert one(spark, tx.joined(F.lit("a"), F.lit(None), F.lit("b"))) == "a b"
    assert one(spark, tx.joined(F.lit(None), F.lit(""))) is None
    assert one(spark, tx.slug(F.lit("a b/c"))) == "a_b_c"
    assert one(spark, tx.pretty(F.lit("stance_gun_control"), "stance_", {})) == "Gun Control"
    assert one(spark, tx.quotes(F.lit("&gt; said\nno"))) == '"said"\nno'
    assert one(spark, tx.wrapped(F.lit("a" * 100 + " b"))) == "a" * 100 + "\nb\n"
    assert one(spark, tx.field_of(F.lit("Reason: because\nAnswer: yes\n---\nAnswer: no"), "Answer")) == "yes"
    assert one(spark, tx.normalized(F.lit("@me  see https://x.y don’t…"))) == "@USER see HTTPURL do n't ..."


def test_blank_and_sentinel_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("Nan",), (" ︎ ",), ("ok",)], "t string")
    assert [r.t for r in rows.where(~tx.is_sentinel(F.col("t")) & ~tx.is_blank(F.col("t"))).collect()] == ["ok"]


@pytest.mark.parametrize("answer, stance", [("I disagree", "against"), ("agree", "favor"), ("hm\nfavor", "neutral"), ("neutral; against", "neutral"), ("", "neutral")])
def test_stance_answers(spark, answer, stance):
    assert one(spark, tx.parse_stance(F.lit(answer))) == stance


def test_windows_hold_both_ends(spark):
    rows = spark.createDataFrame([(0,), (10,), (11,), (20,), (21,)], "t long")
    spans = op.windows(spark, 0, 20, 10)
    found = sorted((r.window_id, r.t) for r in op.in_windows(rows, spans, 10).collect())
    assert found == [(0, 0), (0, 10), (1, 10), (1, 11), (1, 20)]


def test_weighted_mean_and_variance(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, -1, 1.0), (2, 1, 0.5), (3, 1, 0.0), (4, None, 1.0)], "u int, value int, w double")
    got = {r.u: (r["mean"], r["var"]) for r in op.opinion(rows, ["u"]).collect()}
    assert got == {1: (0.0, 2.0), 2: (1.0, None), 3: (None, None)}


def test_modes_take_the_smallest(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "u int, a string")
    assert [tuple(r) for r in op.modal(rows, "u", "a").collect()] == [(1, "a")]


def test_ensemble_follows_the_running_best(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.6), (1, 1, 1, 0.55), (1, 2, -1, 0.7), (2, 0, 1, 0.4), (2, 1, 0, 0.9), (3, 0, 1, 0.8)], "k int, classifier_idx int, value int, w double")
    got = {r.k: (r.value, r.classifier_idx) for r in op.ensemble(rows, ["k"]).collect()}
    assert got == {1: (-1, 2), 2: (0, 1), 3: (1, 0)}


def test_histograms_close_the_last_bin(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.01,), (-0.1,)], "x double")
    assert {r.bin: r.n for r in rel.histogram(rows, F.col("x"), 0, 1, 2).collect()} == {0: 1, 1: 2}


def test_joins_and_splits(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 7)], "c int, i int, p int")
    assert sorted(r.i for r in rel.without_orphans(rows, ["c"], "p", "i").collect()) == [0, 1]
    a = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    b = spark.createDataFrame([(2,)], "k int")
    assert sorted(tuple(r) for r in rel.outer_counts(a, b, "k", ("x", "y")).collect()) == [(1, 2, 0), (2, 0, 1)]
    parts = spark.range(10).withColumn("l", F.col("id") % 2)
    split = rel.stratified_split(parts, "l", [F.col("id")], (0.5, 0.3))
    assert sorted(r["split"] for r in split.where("l = 0").collect()) == [0, 0, 1, 2, 2]


def test_scores_without_gold_are_zero(spark):
    rows = spark.createDataFrame([("favor", "favor"), ("favor", "against"), ("neutral", "neutral")], "gold string, predicted string")
    got = {r.label: (r.precision, r.recall, r.f1) for r in sc.class_metrics(sc.confusion(rows, []), []).collect()}
    assert got["favor"] == (1.0, 0.5, pytest.approx(2 / 3)) and got["against"] == (0.0, 0.0, 0.0)
    assert sc.macro(sc.class_metrics(sc.confusion(rows, []), []), []).first()[0] == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="unknown label"):
        sc.confusion(spark.createDataFrame([("x", "favor")], "gold string, predicted string"), []).collect()


def test_agreement(spark):
    votes = [(1, a, "favor") for a in range(3)] + [(2, a, "against") for a in range(3)]
    rows = spark.createDataFrame(votes, "item int, annotator int, label string")
    assert tuple(sc.agreement(sc.label_counts(rows, [], "item"), []).first()) == (1.0, 1.0, 0.0)
    rows = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "c")], "item int, draw int, label string")
    assert sc.majority(rows, "item", "label", "draw").first().label == "b"


def test_movement_of_points(spark):
    near, far = one(spark, vec.between(F.lit(1.0), F.lit(3.0))), one(spark, vec.between(F.lit(3.0), F.lit(1.0)))
    assert near + far == pytest.approx(1)
    assert one(spark, vec.away(F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 0.5
    assert one(spark, vec.away(F.lit(1.0), F.lit(1.0), F.lit(2.0))) == 0.5
    assert one(spark, vec.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_densities_sum_to_one(spark):
    rows = spark.createDataFrame([(1, 0, -0.9, 0.01), (2, 0, 0.9, 0.01), (3, 0, 0.1, 0.0), (4, 0, 0.1, None)], "user_id int, issue int, mean double, var double")
    got = {r.g: r.p for r in la.mixture_1d(rows, ["issue"]).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[13] == pytest.approx(1 / 3, abs=1e-6)
    pairs = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.1, 0.2), (0, 1, 0.5, 0.5, 0.0, 0.0), (0, 1, 0.5, 0.5, 0.0, 0.1)], "i int, j int, x double, y double, vx double, vy double")
    assert sum(r.p for r in la.mixture_2d(pairs, ["i", "j"]).collect()) == pytest.approx(1)


def test_equal_beliefs_are_not_polarized(spark):
    rows = spark.createDataFrame([(u, i, 0.3) for u in range(6) for i in range(3)], "user_id int, issue int, b double")
    assert la.symmetric_polarization(rows).first()[0] == pytest.approx(0)
    assert all(r.polarization == pytest.approx(0, abs=1e-12) for r in la.asymmetric_polarization(rows, [0, 1, 2]).collect())
    assert len(la.two_blocks([0, 1, 2, 3])) == 7
    split = spark.createDataFrame([(u, i, float(u % 2)) for u in range(6) for i in range(2)], "user_id int, issue int, b double")
    assert la.asymmetric_polarization(split, [0, 1]).first().polarization == pytest.approx(3 * 3 / (4 * 6 * 6))


def test_rings_are_disjoint_and_loops_go(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 4, "b"), (1, 1, "a"), (1, 3, "b"), (1, 2, "a")], "src int, dst int, type string")
    got = {(r.node, r.ring) for r in gr.rings(rows, spark.createDataFrame([(1,), (9,)], "u int")).collect()}
    assert got == {(2, 1), (3, 1), (4, 2)}
    degrees = {(r.type, r.degree): r.n for r in gr.degree_histogram(rows).collect()}
    assert degrees[("all", 3)] == 3 and degrees[("all", 0)] == 0


def test_trailing_windows_drop_their_ends(spark):
    content = spark.createDataFrame([(1, t, t) for t in range(0, 30, 5)], "user_id int, t long, item long")
    asks = spark.createDataFrame([(1, 99, 20)], "user_id int, ask int, at long")
    assert sorted(r.item for r in gr.trailing(content, asks, ["user_id"], "t", "at", 10).collect()) == [15]


def test_choices_and_steps(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.1), (1, 3, 1.0), (2, 1, 2.0)], "k int, o int, d double")
    got = {(r.k, r.o): r.p for r in dy.choice_probabilities(rows, ["k"], "d", 2.0).collect()}
    assert got[(1, 1)] == pytest.approx(got[(1, 2)]) == pytest.approx(100 / 201) and got[(2, 1)] == 1
    assert [one(spark, dy.nearest_stance(F.lit(x))) for x in (-0.5, 0.5, 0.51)] == [-1, 0, 1]
    line = dy.simulate(spark, 20, 2, seed=3)
    assert line.count() == 60 and line.where("abs(position) > 1").count() == 0


def test_timeline_object_checks_its_columns(spark):
    with pytest.raises(ValueError, match="lack"):
        op.OpinionTimeline(spark.range(1), profiles(spark))
    rows = op.synthetic(spark, 3, 50, 0.1, 1)
    line = op.OpinionTimeline(rows, profiles(spark), "exponential", least=2)
    means = {r.user_id: r["mean"] for r in line.window(0, 50).collect()}
    assert means[0] < -0.8 and abs(means[1]) < 0.2 and means[2] > 0.8
