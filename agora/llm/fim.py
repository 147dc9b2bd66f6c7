"""Fill-in-the-middle: texts cut at unit borders by rank and select over packed bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import whole_texts
from agora.llm.textarrays import Chunk, chunks

#: Bits of a word of the bit vector, and words of a block of its directory.
WORD, BLOCK = 64, 8


class Borders:
    """A packed bit vector with a directory of the bits set before each block.

    rank(i) counts the bits before place i; select(k) is the place of the k-th bit, from 1.
    Both take arrays. The directory costs one number for each WORD * BLOCK bits.
    """

    def __init__(self, bits: np.ndarray):
        size = WORD * BLOCK
        packed = np.zeros((len(bits) // size + 1) * size // 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        count = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.append(0, np.cumsum(count))

    def _low(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The lowest n bits (below WORD) of each word."""
        return self.words[word] & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at // WORD
        out = self.before[word // BLOCK] + np.bitwise_count(self._low(word, at % WORD))
        for j in range(BLOCK - 1):
            out += np.where(j < word % BLOCK, np.bitwise_count(self.words[word // BLOCK * BLOCK + j]), 0)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, k, "left") - 1
        left = k - self.before[block]
        word, open_ = block * BLOCK, np.ones(len(k), bool)
        for _ in range(BLOCK - 1):
            count = np.bitwise_count(self.words[word])
            open_ &= left > count
            left = np.where(open_, left - count, left)
            word = np.where(open_, word + 1, word)
        low = np.zeros(len(k), np.int64)  # the most bits of the word that hold fewer than `left`
        for step in (32, 16, 8, 4, 2, 1):
            low = np.where(np.bitwise_count(self._low(word, low + step)) < left, low + step, low)
        return word * WORD + low


@dataclass(frozen=True)
class Params:
    """Seed of the draws, hundredths of texts that are rearranged and of these in suffix-first form, sentinels."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(not m or m[0] in other[1:] for m in marks for other in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("sentinels must differ, none may begin another, and their first characters may stand nowhere else in them")


def line_ends(chunk: Chunk) -> np.ndarray:
    """Which bytes end a line, the last one of each text among them."""
    ends = chunk.data == 0x0A
    ends[chunk.offsets[1:][np.diff(chunk.offsets) > 0] - 1] = True
    return ends


def _draws(seed: int, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and output of every row's whole text.

    A text's n units are its lines, each with its line feed. The borders of a chunk of
    texts are one packed bit vector: the number of bits in a text is n, and the bits of two
    drawn ranks give the cuts. Draws come from sha256 of `seed:key`. Form psm is prefix,
    suffix, middle, spm suffix, prefix, middle, each part behind its sentinel; plain is
    the text alone, for texts that are empty, hold a sentinel, or are not drawn.

    Null and empty texts have n 0 and are plain. A null key draws by `seed:`. Rows that
    repeat a key are cut alike where their n is equal. An empty table gives an empty
    table; other columns are ignored.
    """
    schema = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
    marks = [m.encode() for m in (params.prefix, params.suffix, params.middle)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                borders, begin = Borders(line_ends(chunk)), chunk.offsets[:-1]
                at = borders.rank(chunk.offsets)
                n, raw = np.diff(at), chunk.text()
                own = ids[chunk.first : chunk.first + chunk.n]
                drawn = np.array([_draws(params.seed, "" if i is None else str(i)) for i in own], np.int64).reshape(-1, 4)
                ranks = np.sort(drawn[:, :2] % (n + 1)[:, None], 1)
                cuts = np.where(ranks > 0, borders.select(np.maximum(at[:-1, None] + ranks, 1).ravel()).reshape(-1, 2) + 1, begin[:, None])
                characters = np.append(0, np.cumsum((chunk.data & 0xC0) != 0x80))
                spots = characters[np.column_stack([begin, cuts])]
                rows: list[tuple] = []
                for i in range(chunk.n):
                    a, b = int(begin[i]), int(chunk.offsets[i + 1])
                    whole = raw[a:b]
                    if a == b or any(m in whole for m in marks) or drawn[i, 2] % 100 >= params.rate:
                        rows.append(("plain", None, None, whole))
                        continue
                    x, y = cuts[i].tolist()
                    prefix, middle, suffix = marks[0] + raw[a:x], marks[2] + raw[x:y], marks[1] + raw[y:b]
                    first = drawn[i, 3] % 100 < params.suffix_first
                    rows.append(("spm" if first else "psm", int(spots[i, 1] - spots[i, 0]), int(spots[i, 2] - spots[i, 1]), suffix + prefix + middle if first else prefix + suffix + middle))
                form, prefix_chars, middle_chars, output = zip(*rows, strict=True)
                columns = [batch.column(0).slice(chunk.first, chunk.n), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return whole_texts(docs).select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(run, schema).withColumnRenamed("id", key)


def restored(output: Column, form: Column, params: Params = Params()) -> Column:
    """The text that an output of its form was made from; a null form gives null."""

    def split(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands between the first sentinel, the second and the middle's, and behind it."""
        a, b, c = len(first), F.instr(output, second), F.instr(output, params.middle)
        return F.substring(output, F.lit(a + 1), b - a - 1), F.substring(output, b + len(second), c - b - len(second)), F.substring(output, c + len(params.middle), F.length(output))

    prefix, suffix, middle = split(params.prefix, params.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = split(params.suffix, params.prefix)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix))
