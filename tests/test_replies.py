import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import replies


def made(a, w, factors, noise, attend, users=25, seed=0, hot=0):
    """Steps of made users, and their states after each."""
    rnd = np.random.default_rng(seed)
    dims, rows, truth = len(factors), [], {}
    cov = factors @ factors.T + noise * np.eye(dims)
    for u in range(users):
        s, home = np.zeros(dims), rnd.normal(0, 1.5, dims)
        for t in range(hot if hot and u == 0 else 40):
            seen = home + rnd.normal(0, 1.5, (rnd.integers(1, 6), dims))
            if attend == "all":
                s = s + a * (seen.mean(0) - s)
            p = np.maximum(np.linalg.norm(seen - s, axis=1), replies.NEAR) ** -w
            j = int(rnd.choice(len(seen), p=p / p.sum()))
            if attend == "chosen":
                s = s + a * (seen[j] - s)
            truth[u, t] = s
            wrote = rnd.multivariate_normal(s, cov) if t % 7 else None
            rows.append((f"u{u}", t, None if wrote is None else wrote.tolist(), seen.tolist(), j, "x"))
    return rows, truth


SCHEMA = "user string, t long, wrote array<double>, seen array<array<double>>, answered int, segment string"


@pytest.mark.parametrize("attend,length", [("chosen", 16), ("all", 256)])
def test_parameters_of_made_users_are_found(spark, attend, length):
    factors = np.array([[0.6], [-0.4], [0.2]])
    rows, truth = made(0.3, 1.4, factors, 0.05, attend, hot=600)
    table = replies.segments(spark.createDataFrame(rows, SCHEMA).repartition(4), "user", [F.col("t")], "wrote", "seen", "answered", 3, length)
    assert table.agg(F.max(F.size("steps"))).first()[0] <= length
    model = replies.fit(table, 3, rank=1, attend=attend)
    assert abs(model.attention - 0.3) < 0.03
    assert abs(model.weight - 1.4) < 3 * model.error + 0.05
    assert np.abs(model.covariance - (factors @ factors.T + 0.05 * np.eye(3))).max() < 0.06
    exact = replies.Replies(0.3, 1.4, 0.1, factors, 0.05)
    got = {(int(r.user[1:]), r.place): np.array(r.state) for r in replies.states(table, exact, 3, attend).collect()}
    assert got.keys() == truth.keys() and all(np.allclose(got[k], truth[k]) for k in truth)


def test_sums_do_not_depend_on_where_users_are_cut(spark):
    """The slope of the likelihood by the attention is that of finite differences, whatever the segments."""
    rows, _ = made(0.4, 0.7, np.zeros((2, 1)), 0.2, "chosen", users=4, seed=3)
    frame = spark.createDataFrame(rows, SCHEMA)

    def residual(a):
        total, s = 0.0, {}
        for user, _, wrote, seen, j, _ in rows:
            now = s.get(user, np.zeros(2))
            s[user] = now + a * (np.array(seen[j]) - now)
            if wrote is not None:
                total += ((np.array(wrote) - s[user]) ** 2).sum() / 2
        return total

    model = replies.Replies(0.35, 0.7, 1.0, np.zeros((2, 0)), 1.0)
    sums = [replies._expected(replies.segments(frame, "user", [F.col("t")], "wrote", "seen", "answered", 2, n), model, 2, "chosen") for n in (3, 500)]
    assert np.allclose(sums[0], sums[1])
    assert sums[0][1] == pytest.approx(-(residual(0.35 + 1e-5) - residual(0.35 - 1e-5)) / 2e-5, rel=1e-4)


def test_odd_rows(spark):
    rows = [("a", 0, None, [], None, "x"), ("a", 1, [1.0], None, None, "x"), ("a", 2, [2.0], [[1.0]], 0, "x"), (None, 0, [0.5], [[1.0], [3.0]], 1, "x")]
    table = replies.segments(spark.createDataFrame(rows, SCHEMA), "user", [F.col("t")], "wrote", "seen", "answered", 1)
    got = {(r.user, r.place): r.state for r in replies.states(table, replies.Replies(0.5, 0.0, 1.0, np.zeros((1, 0)), 1.0), 1).collect()}
    assert got == {("a", 0): [0.0], ("a", 1): [0.0], ("a", 2): [0.5], (None, 0): [1.5]}


def test_users_of_one_segment_need_no_task_of_their_own(spark, monkeypatch):
    """A round over whole users is a pass over segments, without a shuffle by user; cut and whole users mix."""
    rows, truth = made(0.3, 1.0, np.zeros((2, 1)), 0.1, "chosen", users=6, hot=100)
    frame = spark.createDataFrame(rows, SCHEMA)
    model = replies.Replies(0.3, 1.0, 0.1, np.zeros((2, 0)), 0.1)
    mixed = replies.segments(frame, "user", [F.col("t")], "wrote", "seen", "answered", 2, 64)
    assert {r.segments for r in mixed.select("segments").collect()} == {1, 2}
    sums = replies._expected(mixed, model, 2, "chosen")
    got = {(int(r.user[1:]), r.place): np.array(r.state) for r in replies.states(mixed, model, 2).collect()}
    assert got.keys() == truth.keys() and all(np.allclose(got[k], truth[k]) for k in truth)
    monkeypatch.setattr(replies, "_starts", None)
    whole = replies.segments(frame, "user", [F.col("t")], "wrote", "seen", "answered", 2, 128)
    assert np.allclose(replies._expected(whole, model, 2, "chosen", replies._are_cut(whole)), sums)
    assert replies.fit(whole, 2).attention == pytest.approx(0.3, abs=0.05)
