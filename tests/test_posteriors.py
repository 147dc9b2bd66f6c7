"""Sampled posteriors and smooth trajectories against exact ones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import inference, sampling, smooth
from agora.operators.opinions import precisions
from agora.tables import profiles


@pytest.fixture(scope="module")
def obs(spark):
    rnd = np.random.default_rng(5)
    rows = [(u, int(t), int(rnd.integers(-1, 2)) if u != 3 else 1, int(rnd.integers(0, 3)), i) for u, n in ((1, 5), (2, 1), (3, 6), (4, 90)) for i, t in enumerate(np.sort(rnd.integers(0, 40, n)))]
    rows += [(None, 3, 1, 0, 0), (None, 9, -1, 1, 1), (7, 1, None, 0, 0)]
    return spark.createDataFrame(rows, "user_id long, t long, value int, classifier_idx int, comment_id long").repartition(3)


def test_samples_agree_with_all_hidden_stances_summed(spark, obs):
    got = {r.user_id: r for r in sampling.sampled_opinions(obs, profiles(spark), ["user_id"], draws=1500).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    p = {(r.classifier_idx, r.pred_value, r.true_value): r.p for r in inference.row_normalized(profiles(spark)).collect()}
    for user in (1, 2, 3):
        seen = [(r.classifier_idx, r.value) for r in obs.where(f"user_id = {user}").collect()]
        mean = weight = 0.0
        for hidden in itertools.product((-1, 0, 1), repeat=len(seen)):
            n = [hidden.count(s) for s in (-1, 0, 1)]
            w = np.prod([p[c, v, s] for (c, v), s in zip(seen, hidden)]) * np.prod([float(np.prod(range(1, k + 1))) for k in n])
            weight += w
            mean += w * (n[2] - n[0]) / (len(seen) + 3)
        r = got[user]
        assert abs(r["mean"] - mean / weight) < 0.02 and r.n == len(seen) and r.mixing < 1.05
        assert r.p_against + r.p_neutral + r.p_favor == pytest.approx(1)
    again = {r.user_id: r for r in sampling.sampled_opinions(obs.repartition(7), profiles(spark), ["user_id"], draws=1500).collect()}
    assert again == got
    assert sampling.mixing(np.array([[0.0, 0.1, 0.2, 0.1], [5.0, 5.1, 5.2, 5.1]])) > 3


def test_keys_are_sampled_side_by_side(spark, monkeypatch):
    """A group of many keys is one call; groups cut by the bound and kinds that a key lacks change no posterior."""
    calls, real = [], sampling.chains
    monkeypatch.setattr(sampling, "chains", lambda counts, *a: calls.append(len(counts)) or real(counts, *a))
    emission = np.array([[[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]], [[0.7, 0.2, 0.1], [1.0, 1.0, 1.0]]])
    x = sampling.chains(np.array([[6, 0], [6, 0]]), emission, np.random.default_rng(1), 4, 3000, 100, 1.0)
    assert calls == [2] and x.shape == (2, 4, 3000, 3)
    assert np.abs(x.mean((1, 2))[0] - x.mean((1, 2))[1]).max() < 0.02
    monkeypatch.setattr(sampling, "GROUP", 64)
    rows = spark.range(1500).selectExpr("id AS user_id", "int(id % 3) - 1 AS value", "1 AS classifier_idx")
    sampled = sampling.sampled_opinions(rows, profiles(spark), ["user_id"], draws=100)
    assert sampled.rdd.getNumPartitions() >= 6
    got = sampled.collect()
    assert len(got) == 1500 and len({r["mean"] for r in got}) > 1400
    each = [np.mean([r["mean"] for r in got if r.user_id % 3 == k]) for k in range(3)]
    assert each[0] < each[1] < each[2]


@pytest.mark.parametrize("steps", [4, 512])
def test_trajectories_are_those_of_a_dense_solve(spark, obs, steps):
    got = {}
    for r in smooth.trajectories(obs, profiles(spark), ["user_id"], ["t", "comment_id"], 0.8, 12.0, 0.25, steps).collect():
        got.setdefault(r.user_id, {})[r.t, r.comment_id] = (r["mean"], r["var"])
    w = {(r.classifier_idx, r.value): r.w for r in precisions(profiles(spark)).collect()}
    users = {}
    for r in obs.where("value is not null").collect():
        if w[r.classifier_idx, r.value]:
            users.setdefault(r.user_id, []).append((r.t, r.comment_id, r.value, 0.25 / w[r.classifier_idx, r.value]))
    assert got.keys() == users.keys() and None in got
    for user, rows in users.items():
        rows.sort()
        t, y, r = (np.array([x[k] for x in rows], float) for k in (0, 2, 3))
        k = 0.8 * np.exp(-np.abs(t[:, None] - t[None, :]) / 12.0)
        solve = np.linalg.solve(k + np.diag(r), np.column_stack([y, k]))
        mean, var = k @ solve[:, 0], np.diag(k - k @ solve[:, 1:])
        assert np.allclose([got[user][a, b] for a, b, *_ in rows], np.column_stack([mean, var]), atol=1e-9)


def test_keys_of_one_stretch_take_part_in_no_join(spark, obs, monkeypatch):
    """Only cut keys are joined; with none of them there is no join at all."""
    some = {(r.user_id, r.t, r.comment_id): (r["mean"], r["var"]) for r in smooth.trajectories(obs, profiles(spark), ["user_id"], ["t", "comment_id"], steps=20).collect()}
    monkeypatch.setattr(smooth, "_same", None)
    whole = {(r.user_id, r.t, r.comment_id): (r["mean"], r["var"]) for r in smooth.trajectories(obs, profiles(spark), ["user_id"], ["t", "comment_id"]).collect()}
    assert some.keys() == whole.keys() and all(np.allclose(some[k], whole[k]) for k in some)
