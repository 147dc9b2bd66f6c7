"""Line-first cleaning: rules judge lines; a document that loses too many words goes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import whole_texts
from agora.llm.textarrays import IS_SPACE, Chunk, Windows, chunks, distinct, word_numbers

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Signs between the entries of a menu, and signs that end a sentence.
SEPARATORS, STOPS = b"|>", b".!?:;"
#: Stock phrases; a line that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "subscribe to our",
    "skip to content",
    "powered by",
)


@dataclass(frozen=True)
class Rules:
    """The limits of the line rules, and of what a document may lose."""

    max_symbols: float = 0.2  # symbols for each word
    max_separators: float = 0.25  # menu separators for each word, from two words on
    max_upper: float = 0.6  # share of A-Z among A-Z and a-z, from 20 letters on
    unstopped_words: int = 40  # so many words without a sentence end
    max_lost: float = 0.4  # share of a document's words in failed lines


def _sums(marks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL, IS_SEPARATOR, IS_STOP = _table(SYMBOLS), _table(SEPARATORS), _table(STOPS)
IS_UPPER, IS_LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))


def repeated(numbers: np.ndarray, owner: np.ndarray, later: bool) -> np.ndarray:
    """Which entries occur twice or more with the same owner; `later`: without the first of each."""
    if not len(numbers):
        return np.zeros(0, bool)
    return pd.Index(owner * (numbers.max() + 1) + numbers).duplicated("first" if later else False)


def judge(chunk: Chunk, rules: Rules) -> dict[str, np.ndarray]:
    """Counts of each text, how many of its words stand in lines that fail a rule, and where those lines are (cut)."""
    data, n = chunk.data, chunk.n
    starts, ends, first = chunk.words()
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    in_word = _sums(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
    symbol = _sums(IS_SYMBOL[data])
    at = chunk.offsets

    # Words in 3-word windows that occur twice or more.
    numbers, kinds = word_numbers(data, starts, ends)
    windows = Windows(numbers, len(kinds), first, 3)
    owner = windows.owners()
    whole = n_words[owner] >= 3  # a shorter text has no window
    twice = repeated(windows.numbers(), owner, later=False) & whole
    head = windows.starts[twice]
    covered = np.zeros(len(starts) + 3, bool)
    for i in range(3):
        covered[head + i] = True
    covered = _sums(covered[: len(starts)])

    # Lines with at least one word.
    line_starts, line_ends = chunk.edges(data != 10)
    words_before = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    words = words_before[1] - words_before[0]
    kept = words > 0
    lines, _ = distinct(data[data != 10], line_ends - line_starts)
    lines, line_starts, line_ends, words = lines[kept], line_starts[kept], line_ends[kept], words[kept]
    line_doc = np.searchsorted(at, line_starts, "right") - 1
    again = repeated(lines, line_doc, later=True)

    def count(marks: np.ndarray) -> np.ndarray:
        return marks[line_ends] - marks[line_starts]

    upper, lower = count(_sums(IS_UPPER[data])), count(_sums(IS_LOWER[data]))
    failed = again.copy()
    failed |= count(symbol) > rules.max_symbols * words
    failed |= (words > 1) & (count(_sums(IS_SEPARATOR[data])) > rules.max_separators * words)
    failed |= (upper + lower >= 20) & (upper > rules.max_upper * (upper + lower))
    failed |= (words >= rules.unstopped_words) & (count(_sums(IS_STOP[data])) == 0)
    small = chunk.text().lower()
    for phrase in BOILERPLATE:
        found = small.find(phrase.encode())
        while found >= 0:
            k = np.searchsorted(line_starts, found, "right") - 1
            if k >= 0 and found + len(phrase) <= line_ends[k]:
                failed[k] = True
            found = small.find(phrase.encode(), found + 1)
    lost = np.bincount(line_doc[failed], weights=words[failed], minlength=n).astype(np.int64)
    return {
        "n_words": n_words,
        "word_chars": in_word[at[1:]] - in_word[at[:-1]],
        "n_symbols": symbol[at[1:]] - symbol[at[:-1]],
        "n_dup_lines": np.bincount(line_doc[again], minlength=n).astype(np.int64),
        "n_repeat_words": covered[first[1:]] - covered[first[:-1]],
        "lost_words": lost,
        "cut": np.stack([line_starts[failed], line_ends[failed]]),
    }


def without(chunk: Chunk, spans: np.ndarray) -> pa.Array:
    """The chunk's texts less those spans, and less the line break after each."""
    change = np.zeros(len(chunk.data) + 2, np.int64)
    after = spans[1]
    inside = after < chunk.offsets[np.searchsorted(chunk.offsets, spans[0], "right")]  # a break of the same text follows
    np.add.at(change, spans[0], 1)
    np.add.at(change, after + inside, -1)
    kept = np.cumsum(change)[: len(chunk.data)] == 0
    at = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    parts = pa.LargeStringArray.from_buffers(chunk.n, pa.py_buffer(at[chunk.offsets].astype(np.int64)), pa.py_buffer(chunk.data[kept]))
    return parts.cast(pa.string())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")


def line_counts(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", cleaned: bool = False) -> DataFrame:
    """key and COUNTS of every row, with `cleaned` also clean_text: the text less the lines that fail.

    Null texts have no words and an empty clean_text; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = judge(chunk, rules)
                columns = [batch.column(0).slice(chunk.first, chunk.n), *(pa.array(found[c], pa.int64()) for c in COUNTS)]
                if cleaned:
                    columns.append(without(chunk, found["cut"]))
                yield pa.RecordBatch.from_arrays(columns, ["id", *COUNTS, "clean_text"][: len(columns)])

    schema = "id long, " + ", ".join(f"{c} long" for c in COUNTS) + (", clean_text string" if cleaned else "")
    return whole_texts(docs).select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(run, schema).withColumnRenamed("id", key)


def clean(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", cleaned: bool = False) -> DataFrame:
    """line_counts() with base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept:
    neither that, nor over rules.max_lost of the words in failed lines. Repeated rows are
    judged alike, each for itself; an empty table gives an empty table.
    """
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = line_counts(docs, rules, key, text, cleaned).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= rules.max_lost * F.col("n_words")))
