import collections
import zlib

from agora.llm.sharding import shard_by_key
from tests.llm.conftest import texts


def plain_jump(key, shards):
    key %= 1 << 64
    shard, ahead = -1, 0
    while ahead < shards:
        shard = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


def test_shards_match_the_published_loop(edge):
    rows = shard_by_key(edge, 8).collect()
    assert {r.doc_id for r in rows} == texts().keys()
    slots = collections.defaultdict(list)
    for r in rows:
        text = (texts()[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        assert (r.shard, r.grown_shard) == (plain_jump(r.doc_id, 8), plain_jump(r.doc_id, 9))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_repeated_and_null_keys(spark, edge, nothing):
    assert shard_by_key(nothing, 8).count() == 0
    rows = shard_by_key(edge.unionByName(edge), 8).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 2 * len(texts())
    odd = spark.createDataFrame([(None, None), (-3, "a"), (2**62, "")], "doc_id long, text string")
    assert {(r.doc_id, r.shard) for r in shard_by_key(odd, 8).collect()} == {(k, plain_jump(k or 0, 8)) for k in (None, -3, 2**62)}
