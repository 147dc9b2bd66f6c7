"""The byte-level splitting pattern over whole texts, and ids per distinct piece.

public_tokenizers.PATTERN is evaluated as rules on runs of character classes, so numpy
splits a chunk at once; each distinct piece is then encoded once.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

from agora.llm.textarrays import Chunk, distinct

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a piece of its own, by length.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def split(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in the chunk's bytes, and for each text the number of its first piece (n + 1)."""
    codes = np.frombuffer(chunk.text().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(chunk.n + 1, np.int64)
    begins = np.flatnonzero((chunk.data & 0xC0) != 0x80)  # of each code point in the bytes
    kind = classes()[codes]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(begins, chunk.offsets)] = True
    head[n] = True
    mark = head.copy()
    mark[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(mark)
    starts, ends = runs[:-1], runs[1:]
    white = (kind[starts] == SPACE) & ~head[ends]  # white space that something follows
    s, e = starts[white], ends[white]
    mark[e[e - s > 1] - 1] = True
    mark[e[codes[e - 1] == 0x20]] = False
    quote = starts[(ends - starts == 1) & (codes[starts] == 0x27) & ~head[ends]]
    quote = quote[mark[quote] & (kind[np.minimum(quote + 1, n - 1)] == LETTER)]
    if len(quote):
        one, two = codes[quote + 1], codes[np.minimum(quote + 2, n - 1)]
        long = np.zeros(len(quote), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b)) & ~head[quote + 2]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        mark[quote[short | long] + 1] = False
        mark[quote[short] + 2] = True
        mark[quote[long] + 3] = True
    starts = begins[np.flatnonzero(mark[:n])]
    return starts, np.searchsorted(starts, chunk.offsets)


class PieceIds:
    """Ids of pieces; those of at most `longest` bytes are remembered in two generations of up to `most` pieces.

    When the younger generation is full it becomes the older one, and what is not asked
    for again goes; so frequent pieces stay, and memory is bounded.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1 << 18, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, as the bytes of 32-bit numbers."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        ids = list(map(young.get, pieces))
        missing = []
        for i, p in enumerate(pieces):
            if ids[i] is None:
                found = ids[i] = old.get(p)
                if found is None:
                    missing.append(i)
                else:
                    young[p] = found
        for i, made in zip(missing, self.encode([pieces[i] for i in missing]), strict=True):
            found = ids[i] = array("I", made).tobytes()
            if len(pieces[i]) <= self.longest:
                young[pieces[i]] = found
        return ids

    def of(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts in order, and where each text's begin (n + 1)."""
        starts, first = split(chunk)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(chunk.n + 1, np.int64)
        number, pieces = distinct(chunk.data, np.diff(np.append(starts, len(chunk.data))))
        ids = self._ids(pieces.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), np.uint32)
        count = size[number]
        at = np.zeros(len(number) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        return flat[np.repeat(begin[number] - at[:-1], count) + np.arange(at[-1])], at[first]
