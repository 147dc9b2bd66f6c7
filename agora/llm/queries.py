"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import bpe, fim, fingerprint, langid, neardup, packing, pages, quality_model, quality_rules, sharding, suffixtree, urls, variants


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_key(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


#: The rules of the URL query.
URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = urls.fit(urls.labelled(table, labels, URL_RULES))
    return urls.judge(table, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(_fold(5) != 0))
    return langid.predict(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels.where(_fold(3) != 1))
    return quality_model.score(docs, model, ["doc_id"]).select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return neardup.near_duplicates(docs, neardup.Params(shingle=4, percent=80)).drop("first")


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = suffixtree.score(docs, _fold(7) != 2)
    return rows.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_bpe": op2_bpe,
    "op3_shard": op3_shard,
    "op4_html": op4_html,
    "op5_urls": op5_urls,
    "op6_language": op6_language,
    "op7_fingerprint": op7_fingerprint,
    "op8_quality": op8_quality,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash": op10_minhash,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_variants": op12_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Line rules and counts of op9_quality_rules in SQL.
OP9_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
p AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(o) WHERE k > 1 GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
f AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^|>]', '', 'g')) AS separators, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^a-z]', '', 'g')) AS low, length(regexp_replace(line, '[^.!?:;]', '', 'g')) AS stops FROM l),
j AS (SELECT doc_id, n, again, again OR symbols > 0.2 * n OR (n > 1 AND separators > 0.25 * n) OR (up + low >= 20 AND up > 0.6 * (up + low)) OR (n >= 40 AND stops = 0) OR PHRASES AS failed FROM f WHERE n > 0),
s AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (failed), 0) AS lost FROM j GROUP BY 1),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.4 * n_words AS kept FROM b"""

#: op10_minhash in SQL, by all pairs that share a shingle.
OP10_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n_shingles + y.n_shingles - i)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, n_shingles, min(m) AS component_id, doc_id = min(m) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles"""

ORACLES: dict[str, str] = {
    "op9_quality_rules": OP9_SQL.replace("\\\\", "\\").replace("PHRASES", "(" + " OR ".join(f"contains(lower(line), '{p}')" for p in quality_rules.BOILERPLATE) + ")"),
    "op10_minhash": OP10_SQL.replace("\\\\", "\\"),
}
