"""Languages and vectors that are learned from texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.functions import language
from agora.operators import wordvectors as wv

SF = "/root/testdata/sf0.01"


def test_a_language_is_told_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where("doc_id % 5 <> 0"), F.col("lang") == "en").cache()
    found = language.judged(docs.where("doc_id % 5 = 0"), model, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and n_grams > 0")
    right, n = found.agg(F.count(F.when(F.col("is_language") == (F.col("lang") == "en"), 1)), F.count(F.lit(1))).first()
    assert n > 150 and right >= 0.97 * n
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 3. -- 4", "x"), (4, "the other " * 40_000, "x"), (5, "漢" * 50, "x")], "doc_id long, text string, gram string")
    got = {r.doc_id: r for r in language.judged(odd, model, "doc_id").collect()}
    assert [got[i].is_language for i in (1, 2, 3, 5)] == [False] * 4 and got[4].is_language and got[1].n_grams == got[3].n_grams == 0
    assert language.fit(docs.where("false"), F.col("lang") == "en").count() == 0


def test_words_are_judged_once_each_and_rare_ones_by_a_join(spark):
    """What is broadcast has a bound, and a text's score does not depend on it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 100")
    model = language.fit(docs, F.col("lang") == "en").cache()
    whole, few, none = ({r.doc_id: (r.n_grams, r.is_language, round(r.odds or 0, 9)) for r in language.judged(docs, model, "doc_id", most=n).collect()} for n in (1 << 17, 50, 0))
    assert whole == few == none and len(whole) == docs.count()
    counts = spark.createDataFrame([("a", 9), ("b", 4), ("c", 4), ("d", 1)], "word string, n long")
    assert [language._frequent(counts, n) for n in (0, 1, 2, 3, 4)] == [10, 9, 9, 4, 0]


@pytest.fixture(scope="module")
def themes(spark):
    """Texts of three themes whose words stand together, and of words of no theme."""
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(600):
        theme = i % 3
        words = [f"{'abc'[theme]}{rnd.integers(0, 12)}" if rnd.random() < 0.6 else f"common{rnd.integers(0, 20)}" for _ in range(30)]
        rows.append((i, " ".join(words), theme))
    return spark.createDataFrame(rows, "id long, text string, theme int").repartition(4)


def test_words_of_a_theme_are_near(spark, themes):
    words = F.split("text", " ")
    pairs = wv.contexts(themes, words)
    vectors = wv.fit(pairs, dims=3)
    v = {r.word: np.array(r.vector) for r in vectors.collect()}
    assert len(v) == 56 and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
    inside = np.mean([v[f"{t}{i}"] @ v[f"{t}{j}"] for t in "abc" for i in range(12) for j in range(i)])
    across = np.mean([v[f"a{i}"] @ v[f"{t}{j}"] for t in "bc" for i in range(12) for j in range(12)])
    assert inside > across + 0.4
    # The same directions as those of the whole matrix.
    x = {(r.word, r.context): r.x for r in wv.associations(pairs).collect()}
    names = sorted(v)
    m = np.array([[x.get((a, b), 0.0) for b in names] for a in names])
    u, s, _ = np.linalg.svd(m)
    whole = u[:, :3] * np.sqrt(s[:3])
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    got = np.stack([v[n] for n in names])
    assert np.abs(got @ got.T - whole @ whole.T).max() < 0.05
    texts = {r.id: (r.theme, np.array(r.embedding)) for r in wv.of_texts(themes, vectors, "id", words, 3).join(themes.select("id", "theme"), "id").collect()}
    sims = [(texts[i][1] @ texts[j][1], texts[i][0] == texts[j][0]) for i in range(60) for j in range(i)]
    assert np.mean([s for s, same in sims if same]) > np.mean([s for s, same in sims if not same]) + 0.3


def test_pairs_are_those_within_the_window(spark):
    rows = spark.createDataFrame([("a b a rare c",), ("c a",), (None,), ("",)], "text string")
    got = {(r.word, r.context): r.n for r in wv.contexts(rows, F.split("text", " "), window=2, least=2).collect()}
    # "b" and "rare" come once and are passed over: a a c, c a.
    assert got == {("a", "a"): 2, ("a", "c"): 3, ("c", "a"): 3}
    odd = wv.of_texts(spark.createDataFrame([(1, "zz"), (2, None)], "id long, text string"), spark.createDataFrame([("a", [1.0])], "word string, vector array<double>"), "id", F.split("text", " "), 1)
    assert {r.id: r.embedding for r in odd.collect()} == {1: None, 2: None}


def test_vectors_do_not_depend_on_chunks_or_on_where_words_are_looked_up(spark, themes, monkeypatch):
    """Counts are packed blocks; many chunks, several blocks and the join of words give what one chunk gives."""
    words = F.split("text", " ")
    whole = wv.counted(themes, words)
    assert whole.pairs() == [(0, 0)] and whole.size == 56
    rows = {(r.word, r.context): r.n for r in wv.contexts(themes, words).collect()}
    assert whole.total == sum(rows.values()) and all(rows[b, a] == n for (a, b), n in rows.items())
    monkeypatch.setattr(wv, "HELD", 1000)
    few = wv.counted(themes, words, chunk=20, most=10)
    assert len(few.pairs()) == 6 and few.total == whole.total
    one, many, table = ({r.word: np.array(r.vector) for r in wv.fit(c, dims=3, passes=1).collect()} for c in (whole, few, wv.contexts(themes, words)))
    assert one.keys() == many.keys() == table.keys()
    for other in (many, table):
        assert max(abs(abs(one[w]) - abs(other[w])).max() for w in one) < 1e-4
    vectors = wv.fit(whole, dims=3, passes=1)
    a, b = ({r.id: np.array(r.embedding) for r in wv.of_texts(themes, vectors, "id", words, 3, most=n).collect()} for n in (1 << 19, 20))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]).max() for i in a) < 1e-9


def test_products_move_sums_of_words_and_no_row_for_a_pair(spark, themes):
    counts = wv.counted(themes, F.split("text", " "))
    assert counts.blocks.count() <= 6  # 3 x 3 parts, a pair of parts once
    assert wv._sums(counts, 1).count() == 1
    assert wv.fit(wv.counted(themes.where("false"), F.split("text", " ")), dims=3).count() == 0


def test_counts_that_differ_by_direction_are_kept(spark):
    pairs = spark.createDataFrame([("a", "x", 5), ("b", "y", 7), ("x", "a", 1)], "word string, context string, n long")
    got = {r.word: np.array(r.vector) for r in wv.fit(pairs, dims=3, more=2).collect()}
    assert got.keys() == {"a", "b", "x"} and abs(got["a"] @ got["b"]) < 1e-4


def test_disk_does_not_grow_with_the_square_of_chunks_or_with_occurrences(spark, themes, monkeypatch):
    """No row is written for an occurrence of a word, rare words make one block for two chunks, and sums of a chunk meet in several tasks."""
    words, names, kept = F.split("text", " "), [], wv.saved
    monkeypatch.setattr(wv, "saved", lambda rows, name: names.append(name) or kept(rows, name))
    few = wv.counted(themes, words, chunk=20, most=10)
    assert "words" not in names  # texts are not written word by word
    assert few.blocks.count() == len(few.pairs()) == 6
    one = {r.word: np.array(r.vector) for r in wv.fit(few, dims=3, passes=1).collect()}
    monkeypatch.setattr(wv, "PLACES", 8)
    assert wv._sums(few, 1).count() == 8  # of 20, 20 and 16 words
    many = {r.word: np.array(r.vector) for r in wv.fit(few, dims=3, passes=1).collect()}
    assert one.keys() == many.keys() and max(abs(abs(one[w]) - abs(many[w])).max() for w in one) < 1e-4


def test_packed_pairs_are_the_pairs():
    a, b, n = np.array([3, 3, 8, 13, 2**30]), np.array([2, 2**30, 9, 16, 2]), np.array([1, 2**40, 3, 1, 7])
    for parts in ((1, 1), (5, 7)):
        # The ends of packed pairs have one remainder each.
        keys = (a << 32) | b if parts == (1, 1) else np.unique((a // 5 * 5 + 3 << 32) | (b // 7 * 7 + 2))
        got, counts = wv._unpack(wv._pack(keys, n[: len(keys)], parts))
        assert got.tolist() == keys.tolist() and counts.tolist() == n[: len(keys)].tolist()
