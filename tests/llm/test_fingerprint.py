import collections
import hashlib
import math
import re

import numpy as np

from agora.llm import fingerprint as fp
from tests.llm.conftest import texts


def exact_likeness(one, two):
    """Generalised Jaccard similarity of two texts' words; of two texts without words 1."""
    x, y = (collections.Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w) for t in (one, two))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_edited_texts_and_likeness(spark, edge):
    docs = {k: t or "" for k, t in texts().items()}
    order = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in fp.edited_likeness(edge).collect()}
    assert rows.keys() == docs.keys()
    prints = {}
    for i, k in enumerate(order):
        r, text, after = rows[k], docs[k], order[(i + 1) % len(order)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + docs[after][:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        same = lambda a, b: sum(a[j : j + fp.HEX] == b[j : j + fp.HEX] for j in range(0, len(a), fp.HEX)) / (len(a) // fp.HEX)
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == same(r.fingerprint, rows[after].fingerprint)


def test_collisions_follow_generalised_jaccard(spark):
    rnd = np.random.default_rng(9)
    params = fp.Params(samples=256)
    words = [f"w{i}" for i in range(60)]
    one = [w for w in words for _ in range(int(rnd.integers(0, 6)))]
    for share in (0.9, 0.6, 0.2):
        two = [w if rnd.random() < share else f"z{rnd.integers(99)}" for w in one]
        frame = spark.createDataFrame([(0, " ".join(one)), (1, " ".join(two))], "k int, t string")
        a, b = (r.p0 for r in fp.fingerprints(frame, ["k"], ["t"], params).orderBy("k").collect())
        x, y = collections.Counter(one), collections.Counter(two)
        exact = sum((x & y).values()) / sum((x | y).values())
        got = sum(a[j : j + 4] == b[j : j + 4] for j in range(0, len(a), 4)) / 256
        assert abs(got - exact) < 4 * math.sqrt(exact * (1 - exact) / 256) + 0.02


def test_nothing_one_and_repeated_rows(spark, nothing, edge):
    assert fp.edited_likeness(nothing).count() == 0
    one = fp.edited_likeness(spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    twice = fp.edited_likeness(edge.unionByName(edge)).collect()
    assert len(twice) == 2 * len(texts())
    # Of two equal rows one has the other as next.
    assert {r.doc_id for r in twice if r.near_next == 1} == set(texts())
    odd = spark.createDataFrame([(None, "x y z"), (2, None), (5_000_000_000_000, "y"), (None, None), (2, "c")], "doc_id long, text string")
    rows = fp.edited_likeness(odd).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == [(-1, 0), (-1, 5), (2, 0), (2, 1), (5_000_000_000_000, 1)]


def test_long_texts_are_as_like_as_their_words(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for k in range(12):
        one, half, none = ([f"{name}{k}x{i}" for i in range(20_000)] for name in ("a", "b", "c"))
        for version, words in enumerate((one, one[:10_000] + half[:10_000], none)):
            rows.append((k, version, " ".join(rnd.permutation(words))))
    got = {(r.k, r.v): r.p0 for r in fp.fingerprints(spark.createDataFrame(rows, "k int, v int, t string"), ["k", "v"], ["t"]).collect()}
    same = lambda a, b: sum(a[j : j + fp.HEX] == b[j : j + fp.HEX] for j in range(0, len(a), fp.HEX)) / (len(a) // fp.HEX)
    assert abs(np.mean([same(got[k, 0], got[k, 1]) for k in range(12)]) - 1 / 3) < 0.1
    assert np.mean([same(got[k, 0], got[k, 2]) for k in range(12)]) < 0.02
