import random

from pyspark.sql import functions as F

from agora.llm import langid
from tests.llm.conftest import texts

WORDS = {"en": "the of and to in is that it was for on are with as his they".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans".split()}


def labelled(spark, n=60):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(5, 40))), lang) for i, lang in enumerate(list(WORDS) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_texts_are_known(spark):
    rows = labelled(spark)
    model = langid.fit(rows.where("doc_id % 5 <> 0"))
    got = langid.predict(rows.where("doc_id % 5 = 0"), model).join(rows, "doc_id")
    assert got.where("lang_pred <> lang or rejected").count() == 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_the_nearest_centroid_is_the_plain_maximum(spark):
    import numpy as np
    import pyarrow as pa

    from agora.llm.textarrays import chunks

    model = langid.fit(labelled(spark))
    cases = [r.text for r in labelled(spark, 5).collect()]
    chunk = next(chunks(pa.array(cases)))
    grams = langid.counts(chunk, model.bits)
    for i, text in enumerate(cases):
        plain = np.zeros(1 << model.bits)
        data = text.encode().lower()
        for n in (2, 3):
            for k in range(len(data) - n + 1):
                code = int.from_bytes(data[k : k + n], "little") + (n << 24)
                plain[(code * 2654435761 % 2**32) >> (32 - model.bits)] += 1
        assert (plain == grams[i]).all()
    best = langid.predict(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), model).collect()
    vectors = model.vectors(grams)
    for r in best:
        scores = [float(vectors[r.doc_id] @ c) for c in model.centroids]
        assert abs(max(scores) - r.score) < 2e-5


def test_edges(spark, edge, nothing):
    model = langid.fit(labelled(spark))
    got = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    for doc_id, text in texts().items():
        letters = any(c.isalpha() for c in text or "")
        assert (got[doc_id].lang_pred == "und") == (not letters)
        assert letters or (got[doc_id].score == 0 and got[doc_id].rejected)
    assert langid.predict(nothing, model).count() == 0
    blank = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(edge, blank).collect()} == {"und"}
    twice = langid.predict(edge.unionByName(edge), model)
    assert twice.groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.count("*").alias("k")).where("n <> 1 or k <> 2").count() == 0


def test_junk_among_the_labelled_rows_teaches_nothing(spark):
    junk = [(1000 + 10 * i + k, text, lang) for i, lang in enumerate(WORDS) for k, text in enumerate(["", "12 345", "x", "漢字仮名交文 日本語文"])]
    rows = labelled(spark)
    model = langid.fit(rows.unionByName(spark.createDataFrame(junk, rows.schema)))
    assert langid.predict(rows, model).where("rejected").count() == 0
    strange = ["漢字仮名交文 日本語文", "только что пришли домой", "9f3ac0de77b1", "x"]
    got = langid.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model)
    assert got.where("not rejected").count() == 0


def test_a_repeated_row_counts_once_in_the_sample(spark):
    rows = [(i, f"the cat and the dog number {i}", "en") for i in range(40)] + [(50 + i, f"der hund und die katze nummer {i}", "de") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hot = frame.limit(1).crossJoin(spark.range(20_000)).select(*frame.columns)
    one, two = langid.fit(frame), langid.fit(frame.unionByName(hot), langid.Params(rows=60_000))
    assert one.languages == two.languages and (one.centroids == two.centroids).all()
