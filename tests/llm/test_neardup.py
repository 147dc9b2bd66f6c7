import itertools
import re

import numpy as np

from agora.llm import neardup
from agora.llm.components import components
from tests.llm.conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain(docs, width, percent):
    sets = {i: plain_set(t, width) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in docs}


def result(frame, params):
    rows = neardup.near_duplicates(frame, params).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}, len(rows)


def test_components_match_all_pairs(spark, edge):
    for width in (4, 5):
        assert result(edge, neardup.Params(shingle=width))[0] == plain(texts(), width, 80)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = {r.doc_id: r.text for r in frame.collect()}
    assert result(frame, neardup.Params(shingle=4))[0] == plain(docs, 4, 80)


def test_chains_that_the_smallest_of_a_bucket_does_not_show(spark):
    rnd = np.random.default_rng(5)
    words = [f"v{i}" for i in rnd.integers(0, 10**6, 400)]
    # Each text replaces the next 4 % of the one before, so only near steps are links.
    docs, order = {}, rnd.permutation(24)
    for step, doc_id in enumerate(order.tolist()):
        docs[doc_id] = " ".join([f"n{i}" if i < 16 * step else w for i, w in enumerate(words)])
    got, _ = result(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), neardup.Params(shingle=4))
    assert got == plain(docs, 4, 80)


def test_small_blocks_find_the_same(spark, edge):
    assert result(edge, neardup.Params(shingle=4, block=3))[0] == plain(texts(), 4, 80)


def test_nothing_and_repeated_rows(spark, edge, nothing):
    assert result(nothing, neardup.Params())[1] == 0
    got, n = result(edge.unionByName(edge), neardup.Params(shingle=4))
    assert n == 2 * len(texts()) and got == plain(texts(), 4, 80)


def test_estimate_follows_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            both, one, two = (np.sort(rnd.integers(0, 2**64, n, dtype=np.uint64)) for n in (int(3000 * share), int(1500 * (1 - share)), int(1500 * (1 - share))))
            regs = [neardup.registers(x, np.array([0, len(x)])) for x in (np.sort(np.concatenate([both, one])), np.sort(np.concatenate([both, two])))]
            errors.append(neardup.estimate(*regs)[0] - share)
        assert abs(np.mean(errors)) < 0.02


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(9, 8), (8, 7), (7, 9), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(101, 161)} == {100} and {got[i] for i in range(501, 560)} == {500} and got[9] == got[8] == 7 and 3 not in got
