"""A corpus pipeline: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a table, which is written and reread as
the next stage's docs. The first three return the columns of documents, the last the
packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import langid, neardup, packing, quality_model
from agora.llm.scratch import save

SEQUENCE = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near enough to a language that the labelled ones teach.

    Documents without a letter go (null and empty texts among them), and those that the
    nearest centroid rejects; where no row has a language, all go. Ties in likeness go to
    the first language by name. Repeated rows are judged alike and all stay or go; an
    empty table gives an empty table.
    """
    model = langid.fit(docs)
    return langid.accepted(docs, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, taught by the labels, scores 0.5 or more.

    Null and empty texts are scored by statistics that are all 0. Null labels and labels
    of unknown documents teach nothing; without labels every document has 0.5 and stays.
    Repeated rows are judged alike; an empty table gives an empty table.
    """
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that of the smallest id.

    Rows without an id come last; of rows of one id and one group, one stays. Null texts
    and texts without words are near nothing and stay. An empty table gives an empty table.
    """
    return neardup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of SEQUENCE tokens.

    Null and empty texts are a piece of the end token alone; rows without an id and
    repeated rows are packed like others; an empty table gives an empty table.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("pack", pack)]
#: No stage's decisions can be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
