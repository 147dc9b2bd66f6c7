import collections
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from agora.llm import variants
from agora.llm.scratch import save

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def counts(docs, params=variants.Params()):
    out = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % params.every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= params.length and n >= params.least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n, params=variants.Params()):
    """Rows of COLUMNS, from counts of words; words are compared where they share a deletion or a mask."""
    near = collections.defaultdict(set)
    meet = collections.defaultdict(set)
    for w in n:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            meet[key].add(w)
    for words in meet.values():
        for a, b in itertools.combinations(words, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= params.times * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return rows


def same(df, want):
    assert sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in df.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("hot", [10_000, 3])
def test_all_short_words_of_two_letters(spark, hot):
    """Runs of equal characters, every heavy and light case, and ties."""
    n = {"".join(w): 3 + (7 * i) % 41 for i, w in enumerate(w for k in range(1, 9) for w in itertools.product("ab", repeat=k)) if i % 3}
    n |= {w + "é": 5 for w in list(n)[::7]} | {"éa" * 5: 4, "c": 9, "abcab": 100, "x" * 3000: 4, "x" * 2999: 40, "x" * 1500 + "y" + "x" * 1499: 5}
    words = save(spark.createDataFrame([(i, w, k) for i, (w, k) in enumerate(n.items())], "id long, word string, n long").repartition(3), "test")
    got = {r.word: (r.n_near, r.best.word) for r in variants.near_words(words, variants.Params(hot=hot)).collect()}
    want = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            want[a].append(b)
            want[b].append(a)
    assert got == {w: (len(x), min(x, key=lambda o: (-n[o], o))) for w, x in want.items()}


def test_documents(spark, edge, nothing):
    """Chains of forms, one very long run in three texts, repeated rows, odd texts, a null key."""
    chain = [("abcde", 3), ("abcdef", 6), ("abcdeg", 12), ("abcdgg", 24), ("xbcdgg", 60), ("Ünder", 3), ("ünder", 9), ("über×mut", 4), ("über÷mut", 9)]
    text = " ".join(w for w, k in chain for _ in range(k))
    rows = [(7000 + i, t) for i, t in enumerate([text, "Z" * 40_000, "z" * 40_000 + " y", "z" * 40_000])] + [(None, "nokey nokey nokey"), (7100, text.upper()), (7100, text)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    for params in (variants.Params(), variants.Params(length=1, least=2, times=1.5, every=3)):
        same(variants.variants(docs, params), plain(counts([(r.doc_id, r.text) for r in docs.collect()], params), params))
    assert variants.variants(nothing).count() == 0


def test_clashing_names(spark, edge):
    more = edge.select("*", *(F.lit("q").alias(c) for c in ("word", "n", "i", "node", "c", "x", "y", "heavy", "best")))
    same(variants.variants(more), plain(counts([(r.doc_id, r.text) for r in edge.collect()])))
