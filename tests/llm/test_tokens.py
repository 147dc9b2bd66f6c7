import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from agora.llm import bpe, packing
from tests.llm.conftest import texts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_pack_matches_the_library_and_fills_sequences(spark, edge):
    size = 64
    tokenizer = Tokenizer.from_file(JSON)
    rows = packing.pack(edge, JSON, size).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, text in texts().items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert sum(r.length for r in own) == len(ids)
        assert all(r.length == size for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    assert not by_doc
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= -(-sum(r.length for r in rows) // size) + 2


def test_pack_of_nothing_and_of_repeated_rows(nothing, edge):
    assert packing.pack(nothing, JSON).count() == 0
    twice = edge.where("doc_id < 20").unionByName(edge.where("doc_id < 20"))
    places = [(r.sequence_id, r.offset) for r in packing.pack(twice, JSON, 64).collect()]
    assert len(places) == len(set(places))


def test_fullest_is_the_best_subset():
    import itertools
    import random

    rnd = random.Random(3)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        size = rnd.randint(max(counts), 60)
        first = max(counts)
        items = [k for k, n in counts.items() for _ in range(n - (k == first))]
        best = max(first + sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if first + sum(c) <= size)
        got = packing.fullest(counts, size)
        assert sum(got) == best
        assert all(n <= counts[k] for k, n in collections.Counter(got).items())


def test_bpe_matches_the_library_and_comes_back(spark, edge, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(edge, RANKS).collect()}
    assert got.keys() == texts().keys()
    for doc_id, text in texts().items():
        ids = library.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(nothing, RANKS).count() == 0


def test_pieces_split_as_the_pattern_does():
    import random

    import pyarrow as pa
    import regex

    from agora.llm.pretokens import split
    from agora.llm.textarrays import chunks

    rnd, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    signs = ["'", "s", "re", " ", "  ", "\n", "a", "B", "1", "²", "é", "!", "'ll", "漢", "ve", "\t", "-", "'t", " ", "́"]
    cases = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(20000)]
    for chunk in chunks(pa.array(cases)):
        starts, first = split(chunk)
        ends = [*starts[1:].tolist(), len(chunk.data)]
        raw = chunk.text()
        for i in range(chunk.n):
            assert [raw[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] == pattern.findall(cases[chunk.first + i])
