import corpus_pipeline
from agora.llm import langid, neardup, quality_model
from tests.llm.test_neardup import plain

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    keep = {r.doc_id for r in langid.predict(docs, model).where("not rejected").collect()}
    stage = corpus_pipeline.language(spark, docs, SF)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == keep
    model = quality_model.fit(stage, labels)
    good = {r.doc_id for r in quality_model.score(stage, model, ["doc_id"]).where("predicted = 1").collect()}
    second = corpus_pipeline.quality(spark, stage, SF)
    assert {r.doc_id for r in second.collect()} == good
    third = corpus_pipeline.near_duplicates(spark, second, SF)
    groups = plain({i: texts[i] for i in good}, neardup.Params().shingle, 80)
    left = {i for i, (_, _, kept) in groups.items() if kept}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == left
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == left
    clean = {r.doc_id for r in labels.where("quality = 1").collect()} & texts.keys()
    assert len(clean & good) >= 0.97 * len(clean)


def test_query_is_registered():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()) == 13


def test_stages_keep_columns_of_any_name(spark, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in ("rejected", "score", "s_words", "k0", "t", "predicted", "kept", "component_id"):
        docs = docs.withColumn(name, docs.doc_id)
    for stage in (corpus_pipeline.language, corpus_pipeline.quality, corpus_pipeline.near_duplicates):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.pack(spark, docs, SF).count() >= 60
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
