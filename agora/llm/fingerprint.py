"""Document fingerprints by consistent weighted sampling, in columns only.

A text is a set of terms (words by their 64-bit hash) weighted by their counts. For each
of `samples` independent draws, every term has gamma(2, 1) variables r and c and a uniform
b, made in columns from hashes of the term, so that the vocabulary has no bound. With
t = floor(ln w / r + b), the term with the smallest ln c - r (t - b + 1) is sampled; the
pair (term, t) is the same for two texts with the probability of their generalised
Jaccard similarity. The smallest value tells the pair, so a signature keeps its hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.scratch import save, shuffle_partitions

HEX = 4  # digits of a fingerprint for each sample
ABREAST = 4  # samples that one row's columns hold: more make a method too long for Java to compile


@dataclass(frozen=True)
class Params:
    """Samples, and the seed of their variables."""

    samples: int = 32
    seed: int = 20010


def draws(term: Column, weights: list[Column], sample: Column, params: Params) -> list[Column]:
    """A term's values ln c - r (t - b + 1) in a sample for several weights, which are logs of counts."""

    def bits(k: int) -> Column:
        return F.xxhash64(term, sample * 3 + (params.seed + k))

    def high(h: Column) -> Column:
        return (F.shiftrightunsigned(h, 32) + F.lit(0.5)) / F.lit(2.0**32)

    def low(h: Column) -> Column:
        return (h.bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(0.5)) / F.lit(2.0**32)

    r, c = (-F.log(high(bits(k)) * low(bits(k))) for k in (0, 1))
    b = high(bits(2))
    return [F.log(c) - r * (F.floor(w / r + b) - b + 1) for w in weights]


def fingerprints(texts: DataFrame, keys: list[str], bodies: list[str], params: Params = Params()) -> DataFrame:
    """keys, for each of the columns `bodies` the fingerprint of its text, named p0, p1, ..., and sha, the last one's sha256.

    Rows must differ in their keys. Where texts is already partitioned by a key, nothing is
    shuffled: a text's words are counted, drawn and reduced where the text lies. Texts of a
    row share the variables of their common terms. A text without words has the
    fingerprint of zeros. Keys may not be named term, group or like the columns here.
    """
    n = len(bodies)
    texts = texts.select(*keys, F.posexplode(F.array(*bodies)).alias("version", "body"))
    texts = texts.withColumn("sha", F.when(F.col("version") == n - 1, F.sha2(F.col("body").cast("binary"), 256)))
    words = F.split(F.lower("body"), r"[\x20\x09-\x0D]+")
    # The empty word keeps texts without words; it is no term.
    terms = texts.select(*keys, "version", "sha", F.explode(F.concat(F.array(F.lit("")), words)).alias("word"))
    # The digest travels as four numbers beside the empty word: it needs no second look at the texts.
    parts = {f"d{i}": F.when(F.col("word") == "", F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long")) for i in range(4)}
    terms = terms.select(*keys, "version", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), *[c.alias(d) for d, c in parts.items()])
    counts = [F.count(F.when(F.col("version") == v, 1)).alias(f"n{v}") for v in range(n)]
    digests = [F.max(d).alias(d) for d in parts]
    weights = terms.groupBy(*keys, "term").agg(*counts, *digests)
    weights = weights.select(*keys, "term", *parts, *[F.when(F.col("term").isNotNull() & (F.col(f"n{v}") > 0), F.log(F.col(f"n{v}").cast("double"))).alias(f"w{v}") for v in range(n)])
    groups = -(-params.samples // ABREAST)
    rows = weights.select("*", F.explode(F.array(*[F.lit(g) for g in range(groups)])).alias("group"))
    mins = []
    for j in range(ABREAST):
        values = draws(F.col("term"), [F.col(f"w{v}") for v in range(n)], F.col("group") * ABREAST + j, params)
        mins += [F.min(value).alias(f"m{v}_{j}") for v, value in enumerate(values)]
    reduced = rows.groupBy(*keys, "group").agg(*mins, *digests)

    def part(v: int, j: int) -> Column:
        m = F.col(f"m{v}_{j}")
        digits = F.lpad(F.hex(F.pmod(F.xxhash64(m), F.lit(16**HEX - 1)) + 1), HEX, "0")
        return F.lower(F.when(m.isNull(), F.lit("0" * HEX)).otherwise(digits))

    found = [F.struct("group", F.concat(*[part(v, j) for j in range(ABREAST)]).alias("digits")) for v in range(n)]
    joined = reduced.groupBy(*keys).agg(*[F.array_sort(F.collect_list(found[v])).alias(f"parts{v}") for v in range(n)], *digests)
    prints = [F.substring(F.array_join(F.col(f"parts{v}.digits"), ""), 1, HEX * params.samples).alias(f"p{v}") for v in range(n)]
    return joined.select(*keys, *prints, F.lower(F.concat(*[F.lpad(F.hex(d), 16, "0") for d in parts])).alias("sha"))


def likeness(one: Column, other: Column, params: Params = Params()) -> Column:
    """The share of samples on which two fingerprints agree.

    Of 16**HEX - 1 values two that differ agree by chance once in 65 535, far below the
    error of the sampling.
    """
    same = F.lit(0)
    for i in range(params.samples):
        a, b = (F.substring(c, i * HEX + 1, HEX) for c in (one, other))
        same = same + F.when(a == b, 1).otherwise(0)
    return same / F.lit(float(params.samples))


def successors(ids: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """ids with the columns next_<name> of the row that follows in `order`; after the last comes the first.

    Rows are dealt over ranges, each ordered by itself; one row of each range is carried to
    the range before, so no task orders all.
    """
    ranged = ids.repartitionByRange(shuffle_partitions(ids.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    ranged = save(ranged, "ranges")
    row = F.struct(*names)
    inside = Window.partitionBy("_range").orderBy(*order)
    rows = ranged.withColumn("_next", F.lead(row).over(inside)).withColumn("_place", F.row_number().over(inside))
    heads = rows.where("_place = 1").select(F.col("_range").alias("_at"), row.alias("_head"))
    # One row for each range that holds any.
    whole = Window.orderBy("_at")
    heads = heads.withColumn("_first", F.first("_head").over(Window.partitionBy().orderBy("_at")))
    heads = heads.select(F.col("_at").alias("_range"), F.coalesce(F.lead("_head").over(whole), "_first").alias("_carried"))
    out = rows.join(heads, "_range").withColumn("_next", F.coalesce("_next", "_carried"))
    return out.select(*ids.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in names])


def edited_likeness(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likeness.

    The edited text has its last third, floor(n_chars / 3) code points, replaced by the
    first as many of the next row's text, by descending key; after the last comes the
    first. Every row gives a row: rows that repeat a key follow one another in the order
    of their texts' hashes, and rows without a key come after all others. Null texts are
    empty; texts without words have a fingerprint of zeros, which is like itself. One row
    is its own next. An empty table gives an empty table; other columns are ignored.

    Rows of one key and one text are one until the end: of m such rows, m - 1 have their
    like as next. Within a key, texts are told apart by a 64-bit hash and their length.
    """
    bare = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # s: twice the length, and one more for rows without a key.
    name = ["k", "h", "s"]
    bare = bare.select(F.coalesce("id", F.lit(0)).alias("k"), F.xxhash64("t").alias("h"), (F.length("t").cast("long") * 2 + F.col("id").isNull().cast("long")).alias("s"), "t")
    ids = bare.groupBy(*name).agg(F.count(F.lit(1)).alias("m"))
    order = [F.pmod("s", F.lit(2)).asc(), F.desc("k"), F.asc("h"), F.asc("s")]
    asks = successors(ids, order, name)
    # Rows of a key and a text beside one another follow themselves: ask 1.
    asked = [(0, F.lit(1).cast("long"), "next_"), (1, F.col("m") - 1, "")]
    asked = F.array(*[F.struct(F.lit(i).alias("ask"), m.alias("times"), *[F.col(prefix + c).alias("next_" + c) for c in name]) for i, m, prefix in asked])
    asks = asks.select(*name, F.explode(F.filter(asked, lambda a: a["times"] > 0)).alias("a")).select(*name, "a.*")
    texts = bare.groupBy(*name).agg(F.first("t").alias("t"))
    # The next row gives its first characters to the row that asks for them.
    next_name = ["next_" + c for c in name]
    lenders = texts.select(*[F.col(c).alias("next_" + c) for c in name], F.col("t").alias("other"))
    n = F.floor(F.col("s") / 2)
    third = F.floor(n / 3)
    asks = save(asks, "asks")
    lent = asks.join(lenders, next_name).select(*name, "ask", F.substring(F.col("other"), F.lit(1), third.cast("int")).alias("lent"))
    both = texts.join(lent, name)
    both = both.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), (n - third).cast("int")), "lent"))
    prints = fingerprints(both.select(*name, "ask", "t", "edited"), [*name, "ask"], ["t", "edited"], params)
    rows = save(prints.join(asks, [*name, "ask"]), "prints")
    after = rows.where("ask = 0").select(*[F.col(c).alias("next_" + c) for c in name], F.col("p0").alias("next_print"))
    rows = rows.join(after, next_name).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select(
        F.when(F.pmod("s", F.lit(2)) == 0, F.col("k")).alias(key),
        n.cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        F.col("p0").alias("fingerprint"),
        F.col("p1").alias("edited_fingerprint"),
        likeness(F.col("p0"), F.col("p1"), params).alias("near_edited"),
        likeness(F.col("p0"), F.col("next_print"), params).alias("near_next"),
    )
