import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import inference as inf
from agora.operators import opinions as op
from agora.tables import profiles


def test_perfect_classifiers_show_the_stance(spark):
    rows = op.synthetic(spark, 5, 200, 0.5, 2)
    post = inf.posterior(rows, profiles(spark))
    got = {r.user_id: r for r in inf.normal(post, ["user_id"]).collect()}
    assert [np.sign(round(got[u].mu, 1)) for u in (0, 1, 3, 4)] == [-1, -1, 1, 1]
    noisy = inf.posterior(rows.withColumn("classifier_idx", F.lit(1)), profiles(spark))
    assert abs(inf.normal(noisy, ["user_id"]).where("user_id = 4").first().mu) < abs(got[4].mu)
    shares = inf.categorical(post, ["user_id"]).first()
    assert shares.p_against + shares.p_neutral + shares.p_favor == pytest.approx(1)


def test_scale_solves_its_equation():
    n, s = np.array([1.0, 10, 500]), np.array([0.0, 4.0, 300.0])
    x = inf.log_scale(n, s)
    assert np.allclose(-n - 1 + s * np.exp(-2 * x) - (x - 0.1) / 0.04, 0, atol=1e-5)


def test_beta_roots_have_no_slope():
    n, up, down = np.array([40.0, 3.0]), np.array([-60.0, -0.1]), np.array([-20.0, -30.0])
    a, b = inf.beta_roots(n, up, down)
    whole = inf.digamma(a + b)
    assert np.allclose(a * (up - n * (inf.digamma(a) - whole)) - (np.log(a) - 2) / 0.04 - 1, 0, atol=1e-4)
    assert np.allclose(b * (down - n * (inf.digamma(b) - whole)) - (np.log(b) - 2) / 0.04 - 1, 0, atol=1e-4)


def test_hidden_states_move_as_made(spark):
    rows = [(u, t, t, 1 if (t // 5) % 2 else -1, 0, "g") for u in range(20) for t in range(20)]
    obs = spark.createDataFrame(rows, "user_id long, t long, comment_id long, value int, classifier_idx int, g string")
    moves = inf.hidden_markov(obs, profiles(spark), "g")
    p = {(r["from"], r["to"]): r.p for r in moves.collect()}
    for s in (-1, 0, 1):
        assert sum(p[s, k] for k in (-1, 0, 1)) == pytest.approx(1)
    assert p[-1, -1] == pytest.approx(0.8, abs=0.03) and p[-1, 1] == pytest.approx(0.2, abs=0.03)
    assert inf.movement_index(moves, ["g"]).first().movement > 0
