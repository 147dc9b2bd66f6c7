"""Whole texts as numpy arrays: words, exact numbers of spans and their hashes, per Arrow batch.

A batch is cut into chunks of whole texts; a text longer than the chunk size is a
chunk of its own, so memory follows the longest text, not the partition. Spans are
told apart by their bytes: Arrow's dictionary numbers the distinct ones of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

#: `[^\x20\x09-\x0D]+` is a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z lower-cased, all other bytes as they are.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk:
    """Rows `first` to `first + n` of a batch: `data` holds their UTF-8 bytes, `offsets` (n + 1) their places."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.n, self.data, self.offsets = first, len(offsets) - 1, data, offsets

    def text(self) -> bytes:
        return self.data.tobytes()

    def edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of `inside`, cut at the ends of texts."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        head = np.zeros(n + 1, bool)
        head[self.offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | head[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | head[1:n]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text the number of its first word (n + 1)."""
        starts, ends = self.edges(~IS_SPACE[self.data])
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 16) -> Iterator[Chunk]:
    """The texts of a string column in order, at most `rows` in a chunk; null is an empty text."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + rows)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def distinct(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of spans that lie one after another in data: a number for each, and the distinct ones by number.

    Two spans have the same number if and only if their bytes are the same.
    """
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = np.ascontiguousarray(data)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return spans.indices.to_numpy().astype(np.int64), spans.dictionary


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """distinct() of the words of a chunk, whose bytes are all that is no white space."""
    return distinct(data[~IS_SPACE[data]], ends - starts)


def hashes_of(spans: pa.Array) -> np.ndarray:
    """128 bits for each span: two rows of 64-bit numbers."""
    raw = b"".join(map(xxhash.xxh3_128_digest, spans.to_pylist()))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint64).reshape(-1, 2).T)


class Windows:
    """All runs of `width` words within each text; `at` (n + 1) is each text's first.

    A text of fewer words, but at least one, has its whole sequence as its only window.
    """

    def __init__(self, words: np.ndarray, kinds: int, first: np.ndarray, width: int):
        count = np.diff(first)
        short = (count > 0) & (count < width)
        made = np.where(short, 1, np.maximum(count - width + 1, 0))
        self.at = np.zeros(len(made) + 1, np.int64)
        np.cumsum(made, out=self.at[1:])
        self.kinds, self.width = kinds, width
        self.starts = starts = np.arange(self.at[-1]) + np.repeat(first[:-1] - self.at[:-1], made)
        size = np.repeat(np.where(short, count, width), made)
        padded = np.append(words, kinds)
        # The number `kinds` stands for no word, so a short text equals no other window.
        self.words = [padded[np.where(j < size, starts + j, len(words))] for j in range(width)]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def numbers(self) -> np.ndarray:
        """The same number for the same words in the same order, and for these alone."""
        out = self.words[0]
        for words in self.words[1:]:
            # Both factors are below 2**31, as a chunk has fewer words than that.
            out = pd.factorize(out * (self.kinds + 1) + words)[0].astype(np.int64)
        return out

    def hashes(self, of_words: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each window from those of its words."""
        of_words = np.append(of_words, np.uint64(0x2545F4914F6CDD1D))
        out = of_words[self.words[0]]
        for words in self.words[1:]:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ of_words[words]
        return mix(out)


def first_of_each(owner: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which entries are the first of their number with their owner."""
    if not len(numbers):
        return np.zeros(0, bool)
    return ~pd.Index(owner * (numbers.max() + 1) + numbers).duplicated()
