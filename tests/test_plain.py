"""Iterative fits against plain versions on fixtures: hidden Markov moves, beta opinions, topic models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import inference as inf
from agora.operators import topics as tp
from agora.tables import profiles


def observed(seed, users=12, groups=("g", "h")):
    rnd = np.random.default_rng(seed)
    rows = []
    for g in groups:
        moves = rnd.dirichlet([2, 1, 1], 3)
        for u in range(users):
            s = rnd.integers(0, 3)
            for t in range(int(rnd.integers(1, 30))):
                seen = s if rnd.random() < 0.8 else rnd.integers(0, 3)
                rows.append((u, t, len(rows), int(seen) - 1, int(rnd.integers(0, 3)), g))
                s = rnd.choice(3, p=moves[s])
    return rows


SCHEMA = "user_id long, t long, comment_id long, value int, classifier_idx int, g string"


def plain_moves(rows, emission, rounds=3000):
    """Moves by expectation and maximisation over single sequences, to the end."""
    by_user = {}
    for u, t, i, v, c, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_user.setdefault(u, []).append(emission[c, v])
    sequences = [np.array(s) for s in by_user.values() if len(s) > 1]
    start, moves = np.full(3, 1 / 3), inf.MOVE_PRIOR / inf.MOVE_PRIOR.sum(1, keepdims=True)
    for _ in range(rounds):
        first, pairs = np.zeros(3), np.zeros((3, 3))
        for e in sequences:
            ahead = [start * e[0]]
            for x in e[1:]:
                ahead.append(ahead[-1] @ moves * x)
                ahead[-1] /= ahead[-1].sum()
            back = [np.ones(3)]
            for x in e[:0:-1]:
                back.insert(0, moves @ (x * back[0]))
                back[0] /= back[0].sum()
            own = ahead[0] * back[0]
            first += own / own.sum()
            for i in range(1, len(e)):
                joint = ahead[i - 1][:, None] * moves * (e[i] * back[i])[None]
                pairs += joint / joint.sum()
        start = np.maximum(first + inf.START_PRIOR - 1, 0)
        start /= start.sum()
        new = np.maximum(pairs + inf.MOVE_PRIOR - 1, 0)
        new = np.where(new.sum(1, keepdims=True) > 0, new / np.maximum(new.sum(1, keepdims=True), 1e-300), moves)
        moved, moves = np.abs(new - moves).max(), new
        if moved < 1e-6:
            return moves
    raise AssertionError("the plain version has not settled")


def test_hidden_moves_and_their_size(spark):
    rows = observed(3)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    emission = {}
    for r in inf.row_normalized(profiles(spark)).collect():
        emission.setdefault((r.classifier_idx, r.pred_value), np.zeros(3))[r.true_value + 1] = r.p
    moves = inf.hidden_markov(table, profiles(spark), "g", rounds=3000, tolerance=1e-6)
    size = {r.g: r.movement for r in inf.movement_index(moves, ["g"]).collect()}
    for g in ("g", "h"):
        want = plain_moves([r for r in rows if r[5] == g], emission)
        got = np.zeros((3, 3))
        for r in moves.where(F.col("g") == g).collect():
            got[r["from"] + 1, r["to"] + 1] = r.p
        assert np.abs(got - want).max() < 1e-3
        assert size[g] == pytest.approx(np.linalg.norm(got - np.eye(3)))
    with pytest.raises(RuntimeError, match="not settled"):
        inf.hidden_markov(table, profiles(spark), "g", rounds=2, tolerance=1e-9)


def test_beta_opinions_are_the_likeliest(spark):
    """No alpha and beta near those found make the posterior larger."""
    post = inf.posterior(spark.createDataFrame(observed(5), SCHEMA), profiles(spark)).cache()
    found = {(r.g, r.user_id): r for r in inf.beta(post, ["g", "user_id"]).collect()}
    z = np.log([1e-6, 0.5, 1 - 1e-6])
    sums = {}
    for r in post.collect():
        q = np.array([r.q_against, r.q_neutral, r.q_favor])
        sums.setdefault((r.g, r.user_id), np.zeros(3))
        sums[r.g, r.user_id] += (1, q @ z, q @ z[::-1])
    assert found.keys() == sums.keys()
    from math import lgamma, log

    def value(a, b, n, up, down):
        prior = sum(-((log(x) - 2) ** 2) / (2 * 0.2**2) - log(x) for x in (a, b))
        return (a - 1) * up + (b - 1) * down - n * (lgamma(a) + lgamma(b) - lgamma(a + b)) + prior

    for k, r in found.items():
        best = value(r.alpha, r.beta, *sums[k])
        for da, db in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98), (1.02, 1.02), (0.98, 0.98), (1.02, 0.98)):
            assert value(r.alpha * da, r.beta * db, *sums[k]) <= best + 1e-9


def test_topic_models_applied_merged_and_nested(spark):
    rnd = np.random.default_rng(6)
    x = np.vstack([rnd.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 0), (4.5, 0.5, 0))])
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    model = tp.fit(frame, 4, reduced=2, share=1.0)
    placed = x @ model.components

    def applied(model):
        d = np.linalg.norm(placed[:, None] - model.centers[None], axis=2)
        best = d.argmin(1)
        return [tp.OUTLIER if d[i, k] > model.reach[k] else model.names[k] for i, k in enumerate(best)], d.min(1)

    for m in (model, model.merged(3), model.merged(1)):
        want, far = applied(m)
        got = m.apply(frame).orderBy("vec_id").collect()
        assert [r.topic for r in got] == want and np.allclose([r.distance for r in got], far)
    # The tree merges the two nearest means, again and again.
    names, steps = list(model.names), []
    while len({*names}) > 1:
        mean = {n: model.centers[[k for k, m in enumerate(names) if m == n]].mean(0) for n in {*names}}
        d, a, b = min((np.linalg.norm(mean[a] - mean[b]), a, b) for a in mean for b in mean if a < b)
        steps.append((a, b, d))
        names = [a if n == b else n for n in names]
    assert [(a, b) for a, b, _ in model.tree()] == [(a, b) for a, b, _ in steps]
    assert np.allclose([d for *_, d in model.tree()], [d for *_, d in steps])
    # Topics within a topic are those of a model of its rows alone.
    inner = {r.vec_id: (r.topic, r.subtopic) for r in tp.within_topics(frame, model, 2, reduced=None, share=1.0).collect()}
    outer, _ = applied(model)
    assert [inner[i][0] for i in range(len(x))] == outer
    topic = next(t for t in outer if t != tp.OUTLIER)
    own = frame.where(F.col("vec_id").isin([i for i, t in enumerate(outer) if t == topic]))
    alone = {r.vec_id: r.topic for r in tp.fit(own, 2, reduced=None, share=1.0).apply(own).collect()}
    pairs = {(inner[i][1], t) for i, t in alone.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
