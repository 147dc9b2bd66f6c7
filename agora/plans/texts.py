"""Text expressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import text as tx
from agora.registry import query
from agora.tables import read

_TOKEN = tx.TOKEN.replace("'", "''")


def _rewritten(x: str) -> str:
    for a, b in tx.REWRITES:
        quoted = [v.replace("'", "''") for v in (a, b)]
        x = f"replace({x}, '{quoted[0]}', '{quoted[1]}')"
    return x


#: A user, a link and contractions before each text, so that every rule has its case.
MESSAGE_SQL = "msg AS (SELECT conv_id, turn, '@user' || turn || ' see https://example.com/' || turn || ' I can''t, cannot and won''t at 5 p . m . ' || coalesce(text, '') || ' ’s…' AS text FROM conversations)"
TOKEN_SQL = f"{MESSAGE_SQL}, tok AS (SELECT conv_id, turn, list_transform(regexp_extract_all(replace(replace(text, '’', ''''), '…', '...'), '{_TOKEN}'), lambda t: CASE WHEN t[1] = '@' AND length(t) > 1 THEN '@USER' WHEN starts_with(lower(t), 'http') OR starts_with(lower(t), 'www') THEN 'HTTPURL' ELSE t END) AS tokens FROM msg)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    text = F.concat(F.lit("@user"), turn, F.lit(" see https://example.com/"), turn, F.lit(" I can't, cannot and won't at 5 p . m . "), F.coalesce("text", F.lit("")), F.lit(" ’s…"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


@query(f"WITH {TOKEN_SQL} SELECT conv_id, turn, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens FROM tok")
def tweet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).withColumn("tokens", tx.normalized_tokens(F.col("text")))
    return rows.select("conv_id", "turn", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {TOKEN_SQL}, j AS (SELECT conv_id, turn, {_rewritten('array_to_string(tokens, chr(32))')} AS x FROM tok) SELECT conv_id, turn, array_to_string(list_filter(string_split(x, ' '), lambda t: t <> ''), ' ') AS text FROM j")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", tx.normalized(F.col("text")).alias("text"))


_SIGNS = {"☀": ":black_sun_with_rays:", "❤": ":heavy_black_heart:", "⚽": ":soccer_ball:"}


@query(f"SELECT conv_id, turn, 'so ' || CASE turn % 3 WHEN 0 THEN '{_SIGNS['☀']}' WHEN 1 THEN '{_SIGNS['❤']}' ELSE '{_SIGNS['⚽']}' END || ' !' AS text FROM conversations")
def named_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.element_at(F.array(*map(F.lit, _SIGNS)), (F.col("turn") % 3 + 1).cast("int"))
    text = F.concat(F.lit("so "), sign, F.lit("!"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.normalized_tokens(text, signs=True), " ").alias("text"))


_WORDS = ", ".join(f"'{w}'" for w in tx.ENGLISH)


@query(f"WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS words FROM documents) SELECT lang, count(*) FILTER (len(words) > 0 AND len(list_filter(words, lambda x: x IN ({_WORDS}))) >= 0.15 * len(words)) AS english, count(*) AS n FROM w GROUP BY 1")
def english_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.when(tx.is_english(F.col("text")), 1)).alias("english"), F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace('&gt; ' || text, '(?m)^&gt;\s*(.*)$', '" + '"' + r"\1" + '"' + "', 'g')) AS quoted FROM documents")
def quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.quotes(F.concat(F.lit("&gt; "), "text")).cast("binary")).alias("quoted"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'First' ELSE array_to_string(list_transform(string_split(replace(CASE WHEN starts_with('stance_' || p_type, 'stance_') THEN ('stance_' || p_type)[8:] ELSE p_type END, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS label FROM part")
def pretty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    label = tx.pretty(F.concat(F.lit("stance_"), "p_type"), "stance_", {})
    return part.select("p_partkey", F.when(F.col("p_brand") == "Brand#1", "First").otherwise(label).alias("label"))


#: Answers that models give, by the number of a document.
REPLY_SQL = "reply AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Favor.' WHEN 1 THEN ' against ' WHEN 2 THEN 'I would say NEUTRAL' WHEN 3 THEN 'neutral!' ELSE 'So the stance is: favor' END AS answer, CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS one, CASE doc_id % 4 WHEN 0 THEN 'yes' ELSE 'No.' END AS two FROM documents)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(k: int, *answers: str):
        return F.element_at(F.array(*map(F.lit, answers)), (F.col("doc_id") % k + 1).cast("int"))

    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", pick(5, "Favor.", " against ", "I would say NEUTRAL", "neutral!", "So the stance is: favor").alias("answer"), pick(3, "Yes", "no", "maybe").alias("one"), pick(4, "yes", "No.", "No.", "No.").alias("two"))


@query(rf"""WITH {REPLY_SQL}, y AS (SELECT *, CASE WHEN contains(lower(one), 'yes') THEN 'yes' ELSE 'no' END AS a, CASE WHEN contains(lower(two), 'yes') THEN 'yes' ELSE 'no' END AS b, lower(trim(answer)) AS low FROM reply)
SELECT doc_id, CASE WHEN a = 'yes' AND b = 'no' THEN 'favor' WHEN a = 'no' AND b = 'yes' THEN 'against' ELSE 'neutral' END AS both, CASE WHEN ends_with(low, 'favor') THEN 'favor' WHEN ends_with(low, 'against') THEN 'against' ELSE 'neutral' END AS suffix, coalesce(nullif(lower(regexp_extract(answer, '(?i)^\s*(favor|against|neutral)\s*[.!]?\s*$', 1)), ''), '-') AS chosen FROM y""")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replies(spark, sf_dir)
    both = tx.two_answers(tx.parse_yes_no(F.col("one")), tx.parse_yes_no(F.col("two")))
    return rows.select("doc_id", both.alias("both"), tx.suffix_label(F.col("answer")).alias("suffix"), F.coalesce(tx.chosen(F.col("answer"), "stance"), F.lit("-")).alias("chosen"))


@query(r"""SELECT doc_id, lang AS stance, 'number ' || (doc_id % 7) AS reason, strftime(TIMESTAMP '2020-01-15' + to_months(CAST(doc_id % 40 AS INTEGER)), '%Y-%m') AS year_month, CAST(doc_id % 1000 AS INTEGER) AS number, CASE doc_id % 6 WHEN 0 THEN 'against' WHEN 1 THEN 'against' WHEN 2 THEN 'neutral' WHEN 3 THEN 'favor' WHEN 4 THEN 'favor' ELSE '-' END AS label, CAST(CASE doc_id % 6 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE -9 END AS INTEGER) AS value FROM documents""")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a written answer, the month and the number in file names, labels of codes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    answer = F.concat(F.lit("Stance: "), "lang", F.lit("\nReason: number "), (F.col("doc_id") % 7).cast("string"), F.lit("\n---\nReason: none"))
    month = F.date_format(F.add_months(F.lit("2020-01-15").cast("date"), (F.col("doc_id") % 40).cast("int")), "yyyy-MM")
    code = F.element_at(F.array(*map(F.lit, ("-2", "-1", "0", "1", "2", "x"))), (F.col("doc_id") % 6 + 1).cast("int"))
    label = tx.label_of_code(code)
    return docs.select(
        "doc_id",
        tx.field_of(answer, "Stance").alias("stance"),
        tx.field_of(answer, "Reason").alias("reason"),
        tx.year_month(F.concat(F.lit("/in/RC_"), month, F.lit(".zst"))).alias("year_month"),
        tx.first_number(F.concat(F.lit("comments_"), (F.col("doc_id") % 1000).cast("string"), F.lit("_x9.parquet"))).alias("number"),
        F.coalesce(label, F.lit("-")).alias("label"),
        F.coalesce(tx.value_of_label(label), F.lit(-9)).alias("value"),
    )


@query(r"""WITH w AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\d!-/:-@\[-`{-~]+'), lambda x: x <> '')) AS word FROM documents), g AS (SELECT doc_id, lang, substr(' ' || word || ' ', CAST(unnest(generate_series(1, length(word))) AS BIGINT), 3) AS gram FROM w), t AS (SELECT gram, count(*) FILTER (lang = 'en') AS own, count(*) FILTER (lang <> 'en') AS other FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY 1),
m AS (SELECT gram, ln((own + 1) / (sum(own) OVER () + count(*) OVER ())) - ln((other + 1) / (sum(other) OVER () + count(*) OVER ())) AS odds FROM t), s AS (SELECT doc_id, count(*) AS n_grams, sum(coalesce(odds, 0)) / count(*) AS odds FROM g LEFT JOIN m USING (gram) GROUP BY 1)
SELECT doc_id, doc_id % 5 = 0 AS held_out, coalesce(n_grams, 0) AS n_grams, round(odds, 6) + 0.0 AS odds, coalesce(odds > 0, FALSE) AS is_language FROM documents LEFT JOIN s USING (doc_id)""")
def learned_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document is English, by character trigrams of four fifths of them."""
    from agora.functions import language

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language.vocabulary(docs, F.when(F.col("doc_id") % 5 != 0, F.col("lang") == "en"))
    found = language.judged(docs, language.learned(known), "doc_id", known=known)
    return found.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "n_grams", (F.round("odds", 6) + F.lit(0.0)).alias("odds"), "is_language")


@query()
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents from the words that stand near one another in them."""
    from agora.operators import wordvectors as wv

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split(F.lower("text"), r"[\s\p{Punct}]+"), lambda w: w != "")
    vectors = wv.fit(wv.counted(docs, words), dims=16, passes=1)
    return wv.of_texts(docs, vectors, "doc_id", words, 16)
