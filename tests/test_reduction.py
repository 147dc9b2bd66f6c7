import numpy as np
from pyspark.sql import functions as F

from agora.operators import reduction


def roll(n, seed):
    """A rolled-up sheet in ten dimensions, and the places on it."""
    rnd = np.random.default_rng(seed)
    t, h = rnd.uniform(1.5 * np.pi, 4 * np.pi, n), rnd.uniform(0, 45, n)
    x = np.column_stack([t * np.cos(t), h, t * np.sin(t), rnd.normal(0, 0.05, (n, 7))])
    # Equal steps along the roll are equal steps on the sheet.
    return x, np.column_stack([(t * np.sqrt(1 + t * t) + np.arcsinh(t)) / 2, h])


def kept(before, after, k=15):
    near = lambda x: np.argsort(((x[:, None] - x[None]) ** 2).sum(2), 1)[:, 1 : k + 1]
    return np.mean([len({*a} & {*b}) / k for a, b in zip(near(before), near(after))])


def test_neighbourhoods_are_kept_better_than_by_principal_components(spark):
    x, sheet = roll(2000, 3)
    rows = spark.createDataFrame([(i, [float(v) for v in row], "x") for i, row in enumerate(x)], "vec_id long, embedding array<double>, reduced string").repartition(4)
    model = reduction.fit(rows.where("vec_id < 1500"), 2, landmarks=512)
    got = {r.vec_id: r.place for r in model.transform(rows, out="place").collect()}
    new = np.array([got[i] for i in range(len(x))])
    centred = x - x[:1500].mean(0)
    components = centred @ np.linalg.svd(centred[:1500], full_matrices=False)[2][:2].T
    # Rows of the fit, and rows that come later.
    for part in (slice(0, 1500), slice(1500, 2000)):
        assert kept(sheet[part], new[part]) > kept(sheet[part], components[part]) + 0.1


def test_matches_the_eigenvectors_of_the_whole_graph(spark):
    x, _ = roll(200, 4)
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    model = reduction.fit(rows, 3, landmarks=40)
    got = np.array([r.reduced for r in model.transform(rows).orderBy("vec_id").collect()])
    place, w = model.weights(x)
    z = np.zeros((200, len(model.landmarks)))
    np.put_along_axis(z, place, w, 1)
    graph = z / z.sum(0) @ z.T
    values, vectors = np.linalg.eigh((graph + graph.T) / 2)
    for j in range(3):
        cosine = got[:, j] @ vectors[:, -2 - j] / np.linalg.norm(got[:, j])
        assert abs(abs(cosine) - 1) < 1e-6


def test_odd_rows(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(100, None), (101, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    model = reduction.fit(rows, 4)
    got = {r.vec_id: r.reduced for r in model.transform(rows).collect()}
    assert got[100] is None and got[101] == got[0] and all(len(v) == 4 and np.isfinite(v).all() for k, v in got.items() if k != 100)
    assert model.transform(rows.where("false")).count() == 0
