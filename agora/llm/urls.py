"""URL filters in columns: host and path rules, then boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.trees import Boosted, boost

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "url_digits", "host_digits", "host_hyphens", "host_entropy", "parameters", "fragment", "longest_label", "vowels", "suffix_rate", "segment_rate")


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class Params:
    """`rows` bounds the labelled sample; suffixes with fewer than `support` rows have the mean rate.

    A share `held` of the sample takes no part in the trees and says how many of them to
    keep: where labels do not follow the URL that is none, and all URLs have the mean. A
    second such share takes part in neither and gives the figures of a fit. The rates that
    trees learn from come out of `folds` parts, each from the rows of the others.
    """

    rows: int = 6000
    rounds: int = 20
    depth: int = 3
    support: int = 20
    held: float = 0.2
    folds: int = 5
    seed: int = 31


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ://, A-Z lower-cased, and the path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def segment(host: Column, path: Column) -> Column:
    """The suffix of a host with the first segment of the path."""
    return F.concat_ws("/", suffix(host), F.regexp_extract(path, r"\A/([^/]*)/", 1))


def _entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.greatest(F.length(text), F.lit(1))
    signs = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(signs, F.lit(0.0), lambda total, c: total - (lambda p: p * F.log2(p))((n - F.length(F.replace(text, c, F.lit("")))) / n))


def features(url: Column, host: Column, path: Column) -> list[Column]:
    """FEATURES but the rates."""
    full = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(full, r"\?([^#]*)", 1)

    def share(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))

    longest = F.aggregate(F.split(host, r"\."), F.lit(0), lambda best, label: F.greatest(best, F.length(label)))
    columns = [
        F.length(full),
        F.length(host),
        F.length(path),
        F.regexp_count(path, F.lit("/")),
        F.regexp_count(host, F.lit(r"\.")),
        share(full, "[0-9]"),
        share(host, "[0-9]"),
        F.regexp_count(host, F.lit("-")),
        _entropy(host),
        F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        F.when(F.instr(full, "#") > 0, 1).otherwise(0),
        longest,
        share(host, "[aeiou]"),
    ]
    return [c.cast("double") for c in columns]


def labelled_by_documents(urls: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """(url, label) of the URLs whose path holds the number of a labelled document.

    label is 1 where the document is of no quality or toxic. A URL whose document has
    several labels counts as unwanted if one says so; null marks say nothing.
    """
    number = F.try_to_number(F.regexp_extract(F.col("url"), r"://[^/?#]*/(?:[^/?#]*/)*([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)", 1), F.lit("9" * 18)).cast("long")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("number")).agg(F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("label"))
    return urls.select(F.col(url).alias("url")).withColumn("number", number).where("number is not null").join(marked, "number").select("url", "label")


def labelled(urls: DataFrame, labels: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """(url, label): what the rules say of the URLs they fit, and of others what their documents' labels say."""
    host, path = host_and_path(F.col(url))
    rows = urls.select(F.col(url).alias("url"), verdict_of(host, path, rules)[1].alias("said")).distinct()
    by_document = labelled_by_documents(rows.where("said is null"), labels)
    return rows.where("said is not null").select("url", F.when(F.col("said") == "block", 1).otherwise(0).alias("label")).unionByName(by_document)


def verdict_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, of equal ones the first by name; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for one in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = one.fits(host, path)
        rule, verdict = F.when(fits, F.lit(one.name)).otherwise(rule), F.when(fits, F.lit(one.verdict)).otherwise(verdict)
    return rule, verdict


@dataclass
class Model:
    trees: Boosted
    rates: list[dict[str, float]]  # of suffixes and of segments
    mean: float
    held_out: dict[str, float] = field(default_factory=dict)  # accuracy, that of the mean alone, and rows, none of which took part

    def rate_columns(self, host: Column, path: Column) -> list[Column]:
        """The rates of a URL's suffix and segment; the mean where they are unknown."""
        out = []
        for name, rates in zip((suffix(host), segment(host, path)), self.rates, strict=True):
            known = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]) if rates else None
            out.append(F.coalesce(F.try_element_at(known, name), F.lit(self.mean)) if rates else F.lit(self.mean))
        return out

    def probability(self) -> Column:
        """That a URL is unwanted: the trees as CASE expressions over the columns f0, f1, ... of FEATURES."""
        raw = self.trees.column([F.col(f"f{i}") for i in range(len(FEATURES))])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))


def fit(labelled: DataFrame, params: Params = Params(), url: str = "url", label: str = "label") -> Model:
    """Boosted trees on at most about params.rows labelled URLs, those of smallest hash; the driver gets these alone.

    A URL counts once, however often it is repeated, with the largest of its labels; null
    URLs and labels teach nothing. Statistics of suffixes, and of suffixes with the first
    segment of the path, are the share of label 1 among the taught URLs, with the mean for
    one more row. A taught URL's own statistics leave out its fold, so that its label does
    not speak in them; all names with enough rows have one, at most rows / support.
    """
    rows = labelled.select(F.col(url).alias("u"), F.col(label).cast("double").alias("y")).where("u is not null and y is not null")
    rows = rows.groupBy("u").agg(F.max("y").alias("y"))
    n = rows.count()
    share = min(1.0, params.rows / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64("u", F.lit(params.seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    host, path = host_and_path(F.col("u"))
    rows = rows.withColumn("h", host).withColumn("p", path)
    got = rows.select("y", suffix(F.col("h")).alias("s"), segment(F.col("h"), F.col("p")).alias("g"), *features(F.col("u"), F.col("h"), F.col("p"))).collect()
    got.sort(key=tuple)
    if not got:
        return Model(Boosted(-6.0), [{}, {}], 0.0)
    y = np.array([r[0] for r in got])
    rnd = np.random.default_rng(params.seed)
    draw, fold = rnd.random(len(y)), rnd.integers(0, params.folds, len(y))
    part = np.where(draw < params.held, 1, np.where(draw < 2 * params.held, 2, 0))  # taught, chooses, measures
    if not (part == 0).any():
        part[:] = 0
    taught = part == 0
    mean = float(y[taught].mean())
    rates = [_rates(got, taught, k, mean, params) for k in (1, 2)]
    x = np.array([[*r[3:], rates[0].get(r[1], mean), rates[1].get(r[2], mean)] for r in got])
    for f in range(params.folds):
        others = [_rates(got, taught & (fold != f), k, mean, params) for k in (1, 2)]
        for i in np.flatnonzero(taught & (fold == f)).tolist():
            x[i, -2:] = others[0].get(got[i][1], mean), others[1].get(got[i][2], mean)
    trees = boost(x[taught], y[taught], params.rounds, params.depth)
    trees = trees.kept(_best(trees, x[part == 1], y[part == 1]) if (part == 1).any() else 0)
    last = part == 2
    said = {"rows": float(last.sum())}
    if last.any():
        said["accuracy"] = float(((trees.raw(x[last]) >= 0) == (y[last] > 0)).mean())
        said["of_mean"] = float(((mean >= 0.5) == (y[last] > 0)).mean())
    return Model(trees, rates, mean, said)


def _rates(rows: list, taught: np.ndarray, column: int, mean: float, params: Params) -> dict[str, float]:
    sums: dict[str, list[float]] = {}
    for i in np.flatnonzero(taught).tolist():
        sums.setdefault(rows[i][column], []).append(rows[i][0])
    return {s: (sum(v) + mean) / (len(v) + 1) for s, v in sums.items() if len(v) >= params.support}


def _best(trees: Boosted, x: np.ndarray, y: np.ndarray) -> int:
    """How many of the trees have the least log loss on rows they have not seen."""
    raws = [trees.kept(k).raw(x) for k in range(len(trees.trees) + 1)]
    losses = [np.logaddexp(0, np.where(y > 0, -raw, raw)).mean() for raw in raws]
    return int(np.argmin(losses))


def judge(urls: DataFrame, model: Model, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and the model's probability of every row.

    The longest rule that fits decides, of equal ones the first by name; without one the
    model does (block from 0.5 on). Null, empty and malformed URLs have empty host and
    path and are judged by their features; repeated rows stay; an empty table gives an
    empty table; other columns are ignored.
    """
    host, path = host_and_path(F.col("u"))
    rows = urls.select(F.col(key).alias("k"), F.col(url).alias("u")).withColumn("h", host).withColumn("p", path)
    # Columns of their own, so that the trees name them and do not repeat what they stand for.
    given = features(F.col("u"), F.col("h"), F.col("p")) + model.rate_columns(F.col("h"), F.col("p"))
    rows = rows.select("*", *[c.alias(f"f{i}") for i, c in enumerate(given)])
    rule, verdict = verdict_of(F.col("h"), F.col("p"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    rows = rows.withColumn("probability", model.probability())
    return rows.select(F.col("k").alias(key), F.col("h").alias("host"), F.col("p").alias("path"), rule.alias("rule"), verdict.alias("verdict"), "probability")
