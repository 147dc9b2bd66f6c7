"""Spelling variants: pairs of words one edit apart, by merging the light subtrees of a trie."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import save, whole_texts
from agora.llm.textarrays import FOLDED, chunks, distinct, mix

#: Longest run in bytes whose crc32 is continued by tables.
SHORT = 64


@dataclass(frozen=True)
class Params:
    """Least code points and occurrences of a word, times its n that a form has; of which runs one character is deleted; hot nodes."""

    length: int = 5
    least: int = 3
    times: int = 2
    every: int = 97
    hot: int = 10_000  # a node with more than this share of all prefixes is broadcast, so at most as many are


@functools.cache
def _zeros() -> np.ndarray:
    """What k zero bytes make of each byte of a crc32: tables [k, place of the byte, byte]."""
    byte = np.arange(256, dtype=np.uint32)
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]  # linear part
    now = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(SHORT):
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


def _continued(before: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings joined, from theirs and the second one's size (at most SHORT)."""
    out = own.copy()
    for k in range(4):
        out ^= _zeros()[size, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def letter_runs(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z, counted by Arrow batch.

    If params.every divides h = crc32 of `key:run`, the run's code point h modulo its length
    goes. Results of fewer than params.length code points are left out.
    """
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), 0xC3]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), 4 << 20):
                data = FOLDED[chunk.data]
                inside = letter[data]
                inside[1:] |= data[:-1] == 0xC3  # the byte after 0xC3 ends a letter
                starts, ends = chunk.edges(inside)
                if not len(starts):
                    continue
                size = ends - starts
                number, spans = distinct(data[inside], size)
                spelled = spans.to_pylist()
                owner = np.searchsorted(chunk.offsets, starts, "right") - 1
                heads = [b"%s:" % str(i).encode() if i is not None else b":" for i in ids[chunk.first : chunk.first + chunk.n]]
                before = np.array([zlib.crc32(h) for h in heads], np.uint32)
                own = np.array([zlib.crc32(s) if len(s) <= SHORT else 0 for s in spelled], np.uint32)
                short = size <= SHORT
                h = np.zeros(len(size), np.uint32)
                h[short] = _continued(before[owner[short]], own[number[short]], size[short])
                for i in np.flatnonzero(~short).tolist():
                    h[i] = zlib.crc32(spelled[number[i]], int(before[owner[i]]))
                changed = h % params.every == 0
                count = np.bincount(number[~changed], minlength=len(spelled)).tolist()
                found = Counter({w: n for w, n in zip(spelled, count, strict=True) if n})
                for i in np.flatnonzero(changed).tolist():
                    word = spelled[number[i]].decode()
                    k = int(h[i]) % len(word)
                    found[(word[:k] + word[k + 1 :]).encode()] += 1
                words = [w for w in found if len(w) - w.count(0xC3) >= params.length]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([found[w] for w in words], pa.int64())], ["word", "n"])

    return whole_texts(docs).select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(run, "word string, n long")


def prefixes(words: DataFrame) -> DataFrame:
    """(id, i, node, c) for each prefix of each word of (id, word): its length, its hash and the next character, empty at the end.

    The hash is the xor of a random number for each character at its place, so all of a
    word's cost no more than its length. Two prefixes of one hash would share a node,
    which changes no pair: a node only names one child that all its words agree on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column(1).to_pylist()
            size = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
            at = np.cumsum(size) - size
            flat = "\0".join(spelled) + "\0" if spelled else ""
            codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
            place = np.arange(len(codes)) - np.repeat(at, size)
            drawn = mix(mix(codes + np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            through = np.append(np.uint64(0), np.bitwise_xor.accumulate(drawn)[:-1]) if len(drawn) else drawn
            node = through ^ np.repeat(through[at], size)
            nexts = [c if c != "\0" else "" for c in flat]
            for a in range(0, len(flat), 1 << 18):
                part = slice(a, a + (1 << 18))
                ids = np.repeat(batch.column(0).to_numpy(), size)[part]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place[part].astype(np.int32)), pa.array(node[part].view(np.int64)), pa.array(nexts[part], pa.string())], ["id", "i", "node", "c"])

    return words.select("id", "word").mapInArrow(run, "id long, i int, node long, c string")


def light_edges(words: DataFrame, params: Params = Params()) -> DataFrame:
    """(id, i, c, heavy): where the path of a word leaves the heavy child of its trie node.

    The heavy child holds most words (ties: the smallest character). A word leaves it at
    most log2 of the number of words times, once more at its own end. Nodes near the root
    have a large share of all rows and are joined by broadcast: they are those with over
    1 / params.hot of all prefixes, so there are fewer than params.hot of them.
    """
    rows = prefixes(words)
    children = rows.groupBy("node", "c").agg(F.count(F.lit(1)).alias("n"))
    child = F.when(F.col("c") != "", F.struct(F.col("n"), (-F.ascii("c")).alias("order"), F.col("c")))
    nodes = children.groupBy("node").agg(F.sum("n").alias("total"), F.max(child).alias("best"))
    nodes = nodes.where(F.col("total") > F.col("best.n")).select("node", "total", F.col("best.c").alias("heavy"))
    nodes = save(nodes, "nodes", fewer=True)
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    hot = F.col("total") * params.hot > total
    near_root = F.broadcast(nodes.where(hot).select("node", "heavy"))
    far = rows.join(near_root.select("node"), "node", "left_anti").join(nodes.where(~hot).select("node", "heavy"), "node")
    return rows.join(near_root, "node").unionByName(far).where(F.col("c") != F.col("heavy")).select("id", "i", "c", "heavy")


def _best(n: Column, word: Column) -> Column:
    """Smallest for the largest n, then for the word that comes first by code points."""
    return F.struct((-n).alias("less"), word.alias("word"))


def near_words(words: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, n_near, best) of the words of (id, word, n) that have a word one edit away; words are distinct.

    Each trie node's light subtrees are merged into its heavy one, small to large, with one
    character replaced or skipped; terminals that then coincide are a pair:

    * replaced, light and heavy: a word takes the heavy character at its light edge;
    * replaced, light and light: words that agree when that character is masked;
    * skipped in the longer word, at the last of equal characters, if its edge is light;
    * skipped in the longer word, if that is in the heavy subtree: the shorter word takes
      the heavy character before its own edge.

    So each pair is found exactly once, and a word asks for at most three others for each
    of its light edges. A masked group has one word for each character of the alphabet; it
    passes on its size and its best two, not its pairs.
    """
    light = light_edges(words, params).join(words, "id")
    x, y, at = F.substring(F.col("word"), F.lit(1), F.col("i")), F.substring(F.col("word"), F.col("i") + 2, F.length("word")), F.col("c")
    light = save(light.select("word", "n", x.alias("x"), "c", y.alias("y"), "heavy"), "light")
    inner = at != ""
    asked = F.array_compact(
        F.array(
            F.when(inner, F.concat("x", "heavy", "y")),
            F.when(inner & ~F.startswith(F.col("y"), at), F.concat("x", "y")),
            F.concat("x", "heavy", "c", "y"),
        )
    )
    asked = light.select("word", "n", F.explode(asked).alias("other"))
    pairs = asked.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    ends = F.array(F.struct(F.col("word"), _best(F.col("m"), F.col("other")).alias("best")), F.struct(F.col("other").alias("word"), _best(F.col("n"), F.col("word")).alias("best")))
    pairs = pairs.select(F.inline(ends)).select("word", F.lit(1).cast("long").alias("n_near"), "best")

    masked = light.where(inner).groupBy("x", "y").agg(F.array_sort(F.collect_list(_best(F.col("n"), F.col("word")))).alias("group")).where(F.size("group") > 1)
    masked = masked.select("group", F.explode("group").alias("own"))
    other = F.when(F.col("own.word") == F.col("group")[0]["word"], F.col("group")[1]).otherwise(F.col("group")[0])
    masked = masked.select(F.col("own.word").alias("word"), (F.size("group") - 1).cast("long").alias("n_near"), other.alias("best"))
    return pairs.unionByName(masked).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents.

    See letter_runs for words and near_words for pairs. A word's form is its near word of
    largest n (ties: the smallest) where that is at least params.times its own n. n at least
    doubles from form to form, so roots are reached in as many rounds as the longest
    chain has steps, at most log2 of the largest n; each round joins only the words
    reached last, and a form is met by no more words than can be near it.

    Null and empty texts have no words; a null key hashes as empty; repeated rows count
    again; an empty table gives an empty table; other columns are ignored.
    """
    counted = letter_runs(docs, params, key, text).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least)
    words = save(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = words.join(near_words(words, params), "word", "left")
    form_n = -F.col("best.less")
    formed = F.col("best").isNotNull() & (form_n >= params.times * F.col("n"))
    rows = save(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, form_n).alias("form_n")), "forms", fewer=True)
    follow = save(rows.where("form IS NOT NULL").select("word", "form"), "follow", fewer=True)
    # Words that have no form and are one come first, then those that follow them, and so on.
    reached = save(follow.select(F.col("form").alias("word")).distinct().join(follow, "word", "left_anti").select("word", F.col("word").alias("root")), "reached", fewer=True)
    roots = []
    while True:
        step = save(follow.join(reached.withColumnRenamed("word", "form"), "form").select("word", "root"), "reached", fewer=True)
        if step.isEmpty():
            break
        roots.append(step)
        reached = step
    found = functools.reduce(DataFrame.unionByName, roots) if roots else follow.select("word", F.col("form").alias("root"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
