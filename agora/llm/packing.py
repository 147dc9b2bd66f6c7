"""Best-fit packing of token sequences by minimum bin slack.

Lengths are at most the bin size, so all there is to plan is a histogram of that many
entries, whatever the corpus. The plan is made on the histogram: a bitset subset-sum
finds the fullest combination of the lengths still there; it is taken as often as the
counts allow. Spark numbers the pieces of each length and joins them to the plan.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agora.llm.pretokens import PieceIds
from agora.llm.scratch import numbered, save, whole_texts
from agora.llm.textarrays import Chunk, chunks

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Tokens:
    """Ids of whole texts as the tokenizers library gives them, without the tokens it adds around a text.

    Pieces go through the file's model once each. Texts that hold a token which the
    library finds before it splits (such as an end of text) are left to the library.
    """

    def __init__(self, tokenizer: Tokenizer, encode: Callable[[list[bytes]], list[list[int]]]):
        self.tokenizer, self.encode = tokenizer, encode
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def of(self, chunk: Chunk, pieces: PieceIds) -> list[np.ndarray]:
        """Ids of each text of a chunk; `pieces` remembers what this task has met."""
        ids, at = pieces.of(chunk)
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        whole = chunk.text()
        if any(token in whole for token in self.added):
            for i in range(chunk.n):
                text = whole[chunk.offsets[i] : chunk.offsets[i + 1]]
                if any(token in text for token in self.added):
                    out[i] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return out


@functools.cache
def json_tokens(path: str) -> Tokens:
    """The ids that a tokenizer file gives to texts."""

    tokenizer = Tokenizer.from_file(path)
    layout = json.loads(tokenizer.to_str())
    if layout["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or layout["normalizer"]:
        raise ValueError("only byte-level tokenizers with the usual splitting pattern are read here")
    # A byte's character: itself where it is printable, else the next one from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    byte_chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    model = tokenizer.model

    def encode(words: list[bytes]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(w.decode("latin-1").translate(byte_chars))] for w in words]

    return Tokens(tokenizer, encode)


def cut(docs: DataFrame, tokenizer: str, size: int, key: str, text: str, end_id: int) -> DataFrame:
    """Each document's ids and `end_id`, cut into pieces of `size` where longer; the first piece takes the rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = json_tokens(tokenizer)
        known = PieceIds(tokens.encode)  # goes with the task, so no worker holds it for other work
        for batch in batches:
            keys = batch.column(0)
            for chunk in chunks(batch.column(1)):
                rows, number, start, length, crc = [], [], [], [], []
                last = np.array([end_id], "<u4").tobytes()
                for i, ids in enumerate(tokens.of(chunk, known)):
                    own = ids.astype("<u4").tobytes() + last
                    n = len(own) // 4
                    a, b, k = 0, (n - 1) % size + 1, 0
                    while a < n:
                        rows.append(chunk.first + i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[4 * a : 4 * b]))
                        a, b, k = b, b + size, k + 1
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return whole_texts(docs).select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(pieces, PIECES)


def fullest(counts: dict[int, int], size: int) -> list[int]:
    """The combination of available lengths with the largest sum of at most `size`.

    It holds the longest length, so that the hard ones go first. Bit s of reach[k] says
    that the first k lengths, each as often as it is there, can fill s.
    """
    lengths = sorted(counts, reverse=True)
    first, room = lengths[0], size - lengths[0]
    if not room:
        return [first]
    full = (1 << (room + 1)) - 1
    reach, used, bits = [], [], 1
    for length in lengths:
        if length > room:
            continue
        copies = min(counts[length] - (length == first), room // length)
        if copies <= 0:
            continue
        reach.append(bits)
        used.append((length, copies))
        step = 1
        while copies:  # binary splitting: 1, 2, 4, ... copies at a time
            take = min(step, copies)
            bits |= (bits << (length * take)) & full
            copies -= take
            step *= 2
        if bits >> room & 1:
            break
    fill = bits.bit_length() - 1
    out = [first]
    for (length, copies), before in zip(reversed(used), reversed(reach), strict=True):
        while not before >> fill & 1 and copies:
            # this length is needed; how often shows by stepping down to a sum that was there before
            k = next(k for k in range(1, copies + 1) if fill >= k * length and before >> (fill - k * length) & 1)
            out += [length] * k
            fill -= k * length
            break
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, bins from, offset, slots): pieces of that length numbered from..to-1.

    A pattern with a length `slots` times takes that many pieces for each bin; slot j of
    bin i is piece from + i * slots + j, at offset + j * length.
    """
    left, done, bins, rows = dict(counts), dict.fromkeys(counts, 0), 0, []
    while left:
        pattern: dict[int, int] = {}
        for length in fullest(left, size):
            pattern[length] = pattern.get(length, 0) + 1
        times = min(left[length] // slots for length, slots in pattern.items())
        offset = 0
        for length, slots in pattern.items():
            rows.append((length, done[length], done[length] + times * slots, bins, offset, slots))
            done[length] += times * slots
            left[length] -= times * slots
            if not left[length]:
                del left[length]
            offset += slots * length
        bins += times
    return rows


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each has.

    Null and empty texts are a piece of `end_id` alone. Equal texts are packed like any
    others, repeated rows give a piece each, and an empty table gives an empty table.
    Other columns are ignored. The driver gets the counts of at most `size` lengths.
    """
    spark = docs.sparkSession
    pieces = save(cut(docs, tokenizer, size, key, text, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    planned = spark.createDataFrame(plan(counts, size), "length int, low long, high long, bin long, at long, slots long")
    # The plan has a few rows for each length; a piece finds its own by its length and its number.
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "rank")
    planned = planned.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "bin", "at", "slots"))).alias("parts"))
    placed = ranked.join(F.broadcast(planned), "length")
    part = F.filter("parts", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"]))[0]
    placed = placed.withColumn("part", part).withColumn("nth", F.col("rank") - F.col("part.low"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("part.bin") + F.floor(F.col("nth") / F.col("part.slots"))).cast("long").alias("sequence_id"),
        (F.col("part.at") + F.pmod(F.col("nth"), F.col("part.slots")) * F.col("length")).cast("long").alias("offset"),
    )
