import numpy as np
from pyspark.sql import functions as F

from agora.llm import quality_model as qm
from agora.llm.trees import boost
from tests.llm.conftest import texts


def test_held_out_documents_are_scored_right(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = qm.fit(docs, labels.where(fold != 1))
    assert 0 < len(model.rules) < 60
    got = qm.score(docs, model, ["doc_id"]).where(fold == 1).join(labels, "doc_id")
    assert got.where("predicted = quality").count() >= 0.97 * got.count()


def test_columns_are_the_rules(spark):
    rnd = np.random.default_rng(2)
    x = rnd.random((400, len(qm.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.6)).astype(float)
    model = qm.fit_rules(x, y)
    assert ((model.probability(x) >= 0.5) == (y == 1)).mean() > 0.97
    frame = spark.createDataFrame(x.tolist(), [f"s_{s}" for s in qm.STATISTICS])
    scores = np.array([r[0] for r in frame.select(model.score()).collect()])
    assert np.allclose(np.sort(scores), np.sort(model.probability(x)))


def test_statistics_match_plain_ones(edge):
    got = {r.doc_id: r for r in qm.with_statistics(edge, ["doc_id"]).collect()}
    for doc_id, text in texts().items():
        words = (text or "").split()
        r = got[doc_id]
        assert r.s_words == len(words)
        if words:
            assert abs(r.s_distinct_share - len(set(words)) / len(words)) < 1e-9
            assert abs(r.s_exclamations - text.count("!") / len(words)) < 1e-9
            assert abs(r.s_longest_run - sum(a == b for a, b in zip(words, words[1:])) / len(words)) < 1e-9
        else:
            assert all(v == 0 for k, v in r.asDict().items() if k != "doc_id" and k not in ("s_line_words", "s_wide"))


def test_edges(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = qm.fit(edge, none)
    assert {r.score for r in qm.score(edge, model, ["doc_id"]).collect()} == {0.5}
    assert qm.score(nothing, model, ["doc_id"]).count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in texts()] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = qm.score(edge.unionByName(edge), qm.fit(edge, some), ["doc_id"])
    assert rows.count() == 2 * len(texts()) and rows.where("score is null or score < 0 or score > 1").count() == 0


def test_boosting_learns_a_corner():
    rnd = np.random.default_rng(1)
    x = rnd.random((500, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    assert ((boost(x, y).raw(x) > 0) == (y == 1)).mean() > 0.98
