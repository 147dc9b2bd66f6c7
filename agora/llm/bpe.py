"""Byte-level BPE on ranks: a segment tree over byte positions finds the next merge.

Many words are merged side by side. Row i of the tree belongs to word i: its leaves hold
the rank of the pair that starts at each position, a node the smallest below it. The
leftmost smallest pair is found from the root; a merge changes at most three leaves.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.pretokens import PieceIds
from agora.llm.scratch import whole_texts
from agora.llm.textarrays import chunks

NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
ALONE_BITS = 9  # words of over 2**8 bytes are merged one at a time


class Ranks:
    """A rank file as byte strings, single-byte ids and a hash table of pairs of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        bits = max(4, (len(pairs) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        for key, rank in pairs.items():
            k = self._place(np.array([key]))[0]
            while self.keys[k] >= 0:
                k = (k + 1) & self.mask
            self.keys[k], self.values[k] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair joined, or NONE."""
        keys = left << np.int64(32) | right
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.values[place], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, as merging the leftmost pair of smallest rank again and again gives."""
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            known = self.rank.get(word)
            if known is not None:
                out[i] = [known]
            elif word:
                by_width.setdefault(max(1, (len(word) - 1).bit_length()), []).append(i)
        for bits, members in by_width.items():
            if bits >= ALONE_BITS:
                for i in members:
                    out[i] = self._merge_alone(words[i])
                continue
            for at in range(0, len(members), step := max(1, (1 << 18) >> bits)):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge_alone(self, word: bytes) -> list[int]:
        """A long word by itself: the same tree in lists, and ranks looked up by the joined bytes."""
        n, rank, none = len(word), self.rank.get, int(NONE)
        half = 1 << (n - 1).bit_length()
        tree = [none] * (2 * half)
        tree[half : half + n - 1] = [rank(word[i : i + 2], none) for i in range(n - 1)]
        for node in range(half - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        # A live token at i covers word[i:after[i]]; before[i] is where the one before begins.
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(leaf: int, value: int) -> None:
            node = leaf + half
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        while tree[1] != none:
            node = 1
            while node < half:
                node *= 2
                node += tree[node] != tree[node // 2]
            here = node - half
            gone = after[here]
            then = after[here] = after[gone]
            put(gone, none)
            if then < n:
                before[then] = here
                put(here, rank(word[here : after[then]], none))
            else:
                put(here, none)
            if here:
                put(before[here], rank(word[before[here] : then], none))
        out, i = [], 0
        while i < n:
            out.append(self.rank[word[i : after[i]]])
            i = after[i]
        return out

    def _merge(self, words: list[bytes], width: int) -> list[list[int]]:
        n, sizes = len(words), np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, self.byte[raw], -1)
        tree = np.full((n, 2 * width), NONE, np.int32)
        pair = inside[:, 1:]
        row, col = np.nonzero(pair)
        tree[row, width + col] = self.of_pairs(ids[row, col], ids[row, col + 1])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # Places of the live neighbours; width stands for none.
        after = np.minimum(np.tile(np.arange(1, width + 1), (n, 1)), width)
        after[np.arange(n), sizes - 1] = width
        before = np.tile(np.arange(-1, width - 1), (n, 1))

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = value
            while node[0] > 1:  # all leaves have the same depth
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            best = tree[live, 1]
            node = np.ones(len(live), np.int64)
            while node[0] < width:
                node = 2 * node
                node += tree[live, node] != best
            here = node - width
            gone = after[live, here]
            then = after[live, gone]
            ids[live, here], ids[live, gone] = best, -1
            after[live, here] = then
            some = then < width
            before[live[some], then[some]] = here[some]
            put(live, gone, np.full(len(live), NONE, np.int32))
            rank = np.full(len(live), NONE, np.int32)
            rank[some] = self.of_pairs(ids[live[some], here[some]], ids[live[some], then[some]])
            put(live, here, rank)
            prior = before[live, here]
            some = prior >= 0
            if some.any():
                rows, prior, here = live[some], prior[some], here[some]
                put(rows, prior, self.of_pairs(ids[rows, prior], ids[rows, here]))
            live = live[tree[live, 1] != NONE]
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the bytes
    that the ids stand for. Null and empty texts have no ids. Equal and repeated rows are
    encoded alike, an empty table gives an empty table, other columns are ignored.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        ids_of = PieceIds(table.merge)  # goes with the task, so no worker holds it for other work
        size = max(table.token) + 1
        written, token = [str(i) for i in range(size)], [table.token.get(i, b"") for i in range(size)]
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ids, at = ids_of.of(chunk)
                said, back = [], []
                for i in range(chunk.n):
                    own = ids[at[i] : at[i + 1]].tolist()
                    said.append(hashlib.sha256(" ".join(map(written.__getitem__, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(token.__getitem__, own))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(np.diff(at)), pa.array(said), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return whole_texts(docs).select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(run, schema).withColumnRenamed("id", key)
