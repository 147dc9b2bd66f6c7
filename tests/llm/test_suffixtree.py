import collections
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from agora.llm import suffixtree
from agora.llm.textarrays import mix

COLUMNS = ("doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score")
END = None


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), END]


def halves(word):
    raw = xxhash.xxh3_128_digest((word or "").encode())
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")


def plain(docs, params):
    """Rows of COLUMNS by dictionaries, from (doc_id, text, learn)."""
    train = [tokens(t) for _, t, learn in docs if learn]
    c = collections.Counter(w for text in train for w in text)
    own = sorted((w for w in c if w is not END), key=lambda w: (-c[w], *halves(w)))[: params.words]
    own = {w: 2 + i for i, w in enumerate(own)}

    def symbol(w):
        if w is END:
            return suffixtree.END
        if w in own:
            return own[w]
        raw = w.encode()
        pair = (raw[-2] if len(raw) > 1 else raw[0]) << 8 | raw[-1]
        return 2 + params.words + int(mix(np.array([pair + 1], np.uint64))[0]) % params.endings

    tail = collections.Counter()
    for w in c:
        if w is not END and w not in own:
            tail[symbol(w)] += c[w] + 1
    follow = collections.defaultdict(collections.Counter)
    for text in train:
        s = [suffixtree.START, *map(symbol, text)]
        for i in range(1, len(s)):
            for d in range(params.depth + 1):
                if i - d >= 0:
                    follow[tuple(s[i - d : i][::-1])][s[i]] += 1
    total, width = sum(follow[()].values()), params.symbols
    p = {(): {x: (follow[()][x] + 1) / (total + width - 1) for x in range(width) if x != suffixtree.START}}

    def longest(context):
        return next(context[:k] for k in range(len(context), -1, -1) if context[:k] in p)

    for d in range(1, params.depth + 1):
        for context in [x for x in follow if len(x) == d]:
            seen = follow[context]
            n = sum(seen.values())
            under = p[longest(context[:-1])]
            saved = sum(k * math.log(k / n / under[x]) for x, k in seen.items())
            if n * params.share >= total and saved > len(seen) * math.log(n) / 2:
                p[context] = {x: (seen[x] + len(seen) * under[x]) / (n + len(seen)) for x in under}
    n_all, v = sum(c.values()), len(c)
    rows = []
    for doc_id, text, learn in docs:
        text = tokens(text)
        s = [suffixtree.START, *map(symbol, text)]
        base = sum(math.log10((c[w] + 1) / (n_all + v + 1)) for w in text)
        own_score = 0.0
        for i, w in enumerate(text, 1):
            own_score += math.log10(p[longest(tuple(s[max(0, i - params.depth) : i][::-1]))][s[i]])
            if w is not END and w not in own:
                own_score += math.log10((c[w] + 1) / (tail[s[i]] + 1))
        rows.append((doc_id, learn, len(text), sum(c[w] > 0 for w in text), n_all, base, own_score))
    return rows, p


def same(got, want):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 4))
    got, want = sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-5)


def fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def learn():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2


@pytest.mark.parametrize("params", [suffixtree.Params(), suffixtree.Params(words=20, endings=8, depth=2, share=50, known=60), suffixtree.Params(words=5, endings=3, depth=4, share=400, known=30)])
def test_texts(spark, edge, params):
    patterns = [" ".join(["a b c d", "d c b a"][i % 2] for _ in range(40)) for i in range(10)] + ["c a b " * 50] * 3
    more = spark.createDataFrame([*((4000 + i, t) for i, t in enumerate(patterns)), (None, "no key"), (4000, "again " * 30)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(more)
    want, p = plain([(r.doc_id, r.text, fold(r.doc_id)) for r in docs.collect()], params)
    assert len(p) > 3 and max(map(len, p)) > 1
    same(suffixtree.score(docs, learn(), params).collect(), want)


def test_nothing_to_learn(spark, edge, nothing):
    docs = edge.select("doc_id", "text")
    same(suffixtree.score(docs, F.lit(None).cast("boolean")).collect(), plain([(r.doc_id, r.text, False) for r in docs.collect()], suffixtree.Params())[0])
    assert suffixtree.score(nothing, learn()).count() == 0


def test_clashing_names(spark, edge):
    more = edge.select("*", *(F.lit("q").alias(c) for c in ("row", "learn", "symbols", "rare", "logs", "h1", "n", "c")))
    assert suffixtree.score(more, learn()).count() == edge.count()


def test_probabilities_sum_to_one_and_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    params = suffixtree.Params()
    words = suffixtree.save(suffixtree.word_counts(docs.where(learn()), params), "words")
    vocab = suffixtree.vocabulary(words, params)
    coded = suffixtree.save(suffixtree.encode(docs, learn(), vocab), "coded")
    tree = suffixtree.fit(coded, params)
    assert np.allclose((10.0 ** tree.log10.astype(float)).sum(1), 1, atol=1e-5)
    held = suffixtree.scored(coded, words, vocab, tree).where("not learned").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (held[0] - held[1]) / held[2] > 0.15
