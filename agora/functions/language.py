"""Whether a text is in a language, by log odds of character n-grams learned from labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.sources.store import saved

#: What stands between words; digits and signs say nothing of a language.
BETWEEN = r"[\s\d\p{Punct}]+"


#: At most so many words are broadcast, those that occur most often.
FREQUENT = 1 << 17


def words(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, word): a row for each word of a text, lower-cased."""
    return texts.select(*keys, F.explode(F.split(F.lower(F.col(text)), BETWEEN)).alias("word")).where("word <> ''")


def grams(word: str | Column, n: int = 3) -> Column:
    """All runs of n characters of a word between two blanks; null for a null word."""
    w = F.col(word) if isinstance(word, str) else word
    padded = F.concat(F.lit(" "), w, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))


def vocabulary(texts: DataFrame, is_language: Column, text: str = "text") -> DataFrame:
    """A saved table (word, own, n): occurrences of each word in texts of the language, all others, and those without a label (own: null)."""
    return saved(words(texts.withColumn("own", is_language), ["own"], text).groupBy("own", "word").agg(F.count(F.lit(1)).alias("n")), "vocabulary")


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count that no more than `most` words have or exceed."""
    held, least = 0, None
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        held += r.words
        if held > most:
            return least if least is not None else r.n + 1
        least = r.n
    return 0


def fit(texts: DataFrame, is_language: Column, text: str = "text", n: int = 3) -> DataFrame:
    """(gram, odds): the log odds of each gram in texts of the language against all others, add-one smoothed.

    A null label teaches nothing. Grams never seen have odds of the add-one share alone,
    which is near 0 and left out.
    """
    return learned(vocabulary(texts, is_language, text), n)


def learned(vocabulary: DataFrame, n: int = 3) -> DataFrame:
    """fit() of the texts of a vocabulary(): each word is cut into grams once, however often it occurs."""
    of_word = vocabulary.where("own is not null").groupBy("word").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("n"))
    table = saved(of_word.select("own", "n", F.explode(grams("word", n)).alias("gram")).groupBy("gram").agg(F.sum("own").alias("own"), (F.sum("n") - F.sum("own")).alias("other")), "grams")
    size = table.agg(F.sum("own").alias("owns"), F.sum("other").alias("others"), F.count(F.lit(1)).alias("kinds"))
    odds = F.log((F.col("own") + 1) / (F.col("owns") + F.col("kinds"))) - F.log((F.col("other") + 1) / (F.col("others") + F.col("kinds")))
    return table.join(F.broadcast(size), F.lit(True)).select("gram", odds.alias("odds"))  # one row


def judged(texts: DataFrame, model: DataFrame, key: str, text: str = "text", n: int = 3, most: int = FREQUENT, known: DataFrame | None = None) -> DataFrame:
    """(key, n_grams, odds, is_language): the mean log odds of a text's grams, and whether it is over 0.

    Null texts and texts without a letter have no gram and are in no language. Keys are
    unique. Each word meets the model once, which may be of any size; texts then meet
    their words: the `most` frequent where the texts are, the rest by a join. known is
    the texts' vocabulary(), if there is one.
    """
    counts = (vocabulary(texts, F.lit(None).cast("boolean"), text) if known is None else known).groupBy("word").agg(F.sum("n").alias("n"))
    parts = counts.select("word", "n", F.explode(grams("word", n)).alias("gram")).join(model, "gram", "left")
    table = saved(parts.groupBy("word", "n").agg(F.count(F.lit(1)).alias("grams"), F.sum(F.coalesce("odds", F.lit(0.0))).alias("sum")), "wordodds")
    least = _frequent(table, most)
    often = table.where(F.col("n") >= least).select("word", "grams", "sum")  # at most `most` rows
    # A row for all frequent words of a text, and one for each other word of it.
    met = words(texts, [key], text).join(F.broadcast(often), "word", "left").groupBy(key, F.when(F.col("grams").isNull(), F.col("word")).alias("word"))
    met = met.agg(F.sum("grams").alias("grams"), F.sum("sum").alias("sum"), F.count(F.lit(1)).alias("n"))
    if least:
        met = saved(met, "met")
        rare = table.where(F.col("n") < least).select("word", F.col("grams").alias("g"), F.col("sum").alias("s"))
        rest = met.where("word is not null").join(rare, "word").select(key, (F.col("g") * F.col("n")).alias("grams"), (F.col("s") * F.col("n")).alias("sum"))
        met = met.where("word is null").select(key, "grams", "sum").unionByName(rest)
    sums = met.groupBy(key).agg(F.sum("grams").alias("n_grams"), (F.sum("sum") / F.sum("grams")).alias("odds"))
    rows = texts.select(key).join(sums, key, "left")
    return rows.select(key, F.coalesce("n_grams", F.lit(0)).alias("n_grams"), "odds", F.coalesce(F.col("odds") > 0, F.lit(False)).alias("is_language"))
