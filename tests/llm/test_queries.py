"""The numbered queries as the driver calls them, on tables with odd rows and one text beyond every chunk."""

import base64
import collections
import hashlib
import json
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agora.llm import fingerprint, suffixtree
from agora.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.llm.conftest import texts
from tests.llm.test_fim import plain as plain_fim
from tests.llm.test_fingerprint import exact_likeness
from tests.llm.test_neardup import plain
from tests.llm.test_quality_rules import plain as plain_counts
from tests.llm.test_suffixtree import plain as plain_scores
from tests.llm.test_urls import plain as plain_url
from tests.llm.test_variants import COLUMNS, counts
from tests.llm.test_variants import plain as plain_variants
from tests.llm.test_variants import same as same_variants

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 9973} and{i % 7}" for i in range(90_000)) + "\n" + "x" * 30_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of the driver's names: odd texts, one of over a MiB, a repeated id, a null id."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "s", 0) for i, t in texts().items()] + [(900, LONG, "en", "s", 0), (None, "no id here", None, None, None), (901, "twice the same id", "en", "s", 0), (901, "twice, but another text", "en", "s", 0)]
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 20").limit(60).withColumn("doc_id", F.col("doc_id") + 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(some)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i % 4 > 0), int(i % 9 == 0)) for i in [*range(5, 70), *range(2021, 2060)]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(9000, None, None), (9000, "no scheme", "<p>x"), (9001, "http://a.com/en/7", "<p>" + "w " * 700_000)], "page_id long, url string, html string")
    pages.unionByName(odd).write.parquet(f"{path}/pages.parquet")
    return path


def rows_of(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_op1(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc_id, text in documents(spark, folder):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first, at, k = (len(ids) - 1) % 2048 + 1, 0, 0
        while at < len(ids):
            end = first if k == 0 else at + 2048
            want[doc_id, k, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
            at, k = end, k + 1
    rows = rows_of(spark, folder, "op1_pack")
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_op2(spark, folder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for doc_id, text in documents(spark, folder):
        ids = library.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows_of(spark, folder, "op2_bpe"))) == want


def test_op3(spark, folder):
    rows = rows_of(spark, folder, "op3_shard")
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents(spark, folder))
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = collections.defaultdict(set)
    for r in rows:
        by_key[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(s) == 1 for s in by_key.values())


def test_op4(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = rows_of(spark, folder, "op4_html")
    assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count()
    for r in rows:
        if r.page_id < 9000:
            doc = docs[int(re.search(r"://[^/]*/[a-z]+/(\d+)", r.url)[1])]
            assert r.text.split("\n\n", 1)[1] == "\n\n".join(" ".join(x.split()) for x in doc.split("\n") if x.strip())
        assert r.n_chars == len(r.text)
    assert sorted(r.n_chars for r in rows if r.page_id >= 9000) == [0, 1, 1_399_999]


def test_op5(spark, folder):
    urls = collections.defaultdict(collections.Counter)
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        host, path = plain_url(r.url)
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        urls[r.page_id][host, path, best and best.name, best and best.verdict] += 1
    got = collections.defaultdict(collections.Counter)
    for r in rows_of(spark, folder, "op5_urls"):
        assert r.verdict in ("allow", "block")
        got[r.page_id][r.host, r.path, r.rule, r.verdict if r.rule else None] += 1
    assert got == urls


def _fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op6(spark, folder):
    rows = rows_of(spark, folder, "op6_language")
    docs = documents(spark, folder)
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in docs)
    silent = {i for i, t in docs if not any(c.isalpha() for c in t or "")}
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in silent)
        assert r.doc_id is None or r.held_out == (_fold(r.doc_id, 5) == 0)
    real = QUERIES["op6_language"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    right, n = real.agg(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count(F.lit(1))).first()
    assert right >= 0.97 * n


def test_op7(spark, folder):
    docs = sorted(documents(spark, folder), key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    rows = rows_of(spark, folder, "op7_fingerprint")
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in docs)
    once = {i for i, n in collections.Counter(i for i, _ in docs).items() if n == 1}
    by_id = {r.doc_id: r for r in rows}
    error = 4 * math.sqrt(0.25 / fingerprint.Params().samples)
    gaps = []
    for k, (doc_id, text) in enumerate(docs):
        after_id, after = docs[(k + 1) % len(docs)]
        if doc_id not in once or after_id not in once:
            continue
        r, text, after = by_id[doc_id], text or "", after or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for said, other in ((r.near_edited, edited), (r.near_next, after)):
            exact = exact_likeness(text, other)
            assert abs(said - exact) <= error
            gaps.append(said - exact)
    assert abs(np.mean(gaps)) < 0.03


def test_op8(spark, folder):
    rows = rows_of(spark, folder, "op8_quality")
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in documents(spark, folder))
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.doc_id is None or r.held_out == (_fold(r.doc_id, 3) == 1)
    real = QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right, n = real.agg(F.count(F.when(F.col("quality") == F.col("predicted"), 1)), F.count(F.lit(1))).first()
    assert right >= 0.95 * n


def test_op9(spark, folder):
    want = collections.Counter((i, *plain_counts(t)) for i, t in documents(spark, folder))
    got = rows_of(spark, folder, "op9_quality_rules")
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_op10(spark, folder):
    docs = documents(spark, folder)
    # Rows are told apart by their place; a null id is larger than all others.
    groups = plain(dict(enumerate(t for _, t in docs)), 4, 80)
    least = {}
    for k, (i, _) in enumerate(docs):
        c = groups[k][1]
        least[c] = min(least.get(c, (True, 0)), (i is None, i or 0))
    want = collections.Counter()
    for k, (i, _) in enumerate(docs):
        none, low = least[groups[k][1]]
        component = None if none else low
        want[i, groups[k][0], component, i == component] += 1
    got = rows_of(spark, folder, "op10_minhash")
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_op11(spark, folder):
    docs = documents(spark, folder)
    params = suffixtree.Params()
    want, _ = plain_scores([(i, t, i is not None and _fold(i, 7) != 2) for i, t in docs], params)
    got = QUERIES["op11_suffix_tree"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), *r[2:5], round(r[5], 3))
    want = sorted(((i, None if i is None else not learn, *rest) for i, learn, *rest in want), key=key)
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_op12(spark, folder):
    rows = QUERIES["op12_variants"](spark, folder)
    assert sorted(rows.columns) == sorted(COLUMNS)
    same_variants(rows, plain_variants(counts(documents(spark, folder))))


def test_op13(spark, folder):
    want = collections.Counter()
    for i, t in documents(spark, folder):
        *row, output = plain_fim(i, t)
        want[i, *row, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = QUERIES["op13_fill_in_middle"](spark, folder)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    got = got[list(want.columns)]
    said = [sorted(map(json.dumps, d.astype(object).values.tolist())) for d in (got, want)]
    assert said[0] == said[1]
