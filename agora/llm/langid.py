"""Language by the nearest of several centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import whole_texts
from agora.llm.textarrays import Chunk, chunks

UNKNOWN = "und"
_WORD_BYTE = np.full(256, 32, np.uint8)
_WORD_BYTE[65:91] = np.arange(97, 123)
_WORD_BYTE[97:123] = np.arange(97, 123)
_WORD_BYTE[128:] = np.arange(128, 256)
_ODD = np.uint32(2654435761)


@dataclass(frozen=True)
class Params:
    """Hashed n-gram features, training rows for each language, centroids, and rejection.

    The fit uses at most about `rows` labelled rows of each language, those of smallest
    hash; rows without a gram teach nothing. `slack` times the quantile `low` of the
    similarities that a centroid has to its own rows is what a text must reach. A centroid
    holds the share `least` of its language's rows or goes.
    """

    bits: int = 12
    rows: int = 600
    centroids: int = 4
    slack: float = 0.5
    low: float = 0.05
    least: float = 0.02
    seed: int = 17

    @property
    def features(self) -> int:
        return 1 << self.bits


def counts(chunk: Chunk, bits: int) -> np.ndarray:
    """Counts of hashed 2- and 3-byte grams of each text's lower-case letters, words apart by one blank."""
    data = _WORD_BYTE[chunk.data]
    at = np.repeat(np.arange(chunk.n), np.diff(chunk.offsets))
    n, width = chunk.n, 1 << bits
    if len(data) < 2:
        return np.zeros((n, width), np.float32)
    # A blank after a blank, or at the start of a text, tells nothing.
    before = np.concatenate([[32], data[:-1]])
    before[chunk.offsets[:-1][chunk.offsets[:-1] < len(data)]] = 32
    keep = (data != 32) | (before != 32)
    data, at = data[keep].astype(np.uint32), at[keep]
    out = np.zeros(n * width, np.float32)
    for size in (2, 3):
        if len(data) < size:
            continue
        code = data[: len(data) - size + 1].copy()
        for k in range(1, size):
            code |= data[k : len(data) - size + 1 + k] << np.uint32(8 * k)
        code = ((code + np.uint32(size << 24)) * _ODD) >> np.uint32(32 - bits)
        own = at[: len(code)]
        same = own == at[size - 1 :]
        out += np.bincount(own[same] * width + code[same], minlength=n * width).astype(np.float32)
    return out.reshape(n, width)


def has_letters(chunk: Chunk) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    ascii_letter = (_WORD_BYTE[chunk.data] != 32) & (chunk.data < 128)
    before = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(ascii_letter, out=before[1:])
    out = before[chunk.offsets[1:]] > before[chunk.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(chunk.offsets) > 0)):
        text = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes().decode()
        out[i] = any(c.isalpha() for c in text)
    return out


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # similarity below which a centroid rejects
    bits: int

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.log1p(grams) * self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _clusters(vectors: np.ndarray, params: Params) -> np.ndarray:
    """Unit centroids by spherical k-means, begun as k-means++; those of too few rows go."""
    rnd = np.random.default_rng(params.seed)
    centers = vectors[[int(rnd.integers(len(vectors)))]]
    while len(centers) < min(params.centroids, len(vectors)):
        far = np.maximum(1 - (vectors @ centers.T).max(1), 0).astype(np.float64)
        if far.sum() < 1e-6:
            break
        centers = np.vstack([centers, vectors[rnd.choice(len(vectors), p=far / far.sum())]])
    for _ in range(12):
        nearest = (vectors @ centers.T).argmax(1)
        centers = np.stack([vectors[nearest == i].mean(0) if (nearest == i).any() else centers[i] for i in range(len(centers))])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount((vectors @ centers.T).argmax(1), minlength=len(centers))
    return centers[(sizes >= params.least * len(vectors)) & (sizes > 0) | (sizes == sizes.max())]


def fit(labelled: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample of the rows whose language is known; the driver gets their counts."""
    rows = labelled.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    rows = rows.withColumn("h", F.xxhash64("id", "t", F.lit(params.seed)))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = F.lit(False)
    for language, n in sizes.items():
        share = min(1.0, params.rows / n)
        wanted |= (F.col("l") == language) & (F.pmod(F.col("h"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), rows=256):
                grams = np.minimum(counts(chunk, params.bits), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array([g.tobytes() for g in grams], pa.binary())], ["l", "grams"])

    # Rows that repeat a key and a text have one hash and count once, so the sample stays bounded.
    once = rows.where(wanted).groupBy("l", "h").agg(F.min("t").alias("t")) if sizes else rows
    got = once.select("l", "t").mapInArrow(vectors, "l string, grams binary").collect() if sizes else []
    got.sort(key=lambda r: (r["l"], r["grams"]))
    grams = np.stack([np.frombuffer(r["grams"], "<u2") for r in got]).astype(np.float32) if got else np.zeros((0, params.features), np.float32)
    named = np.array([r["l"] for r in got])
    taught = grams.any(1)
    grams, named = grams[taught], named[taught]
    idf = np.log((1 + len(grams)) / (1 + (grams > 0).sum(0))).astype(np.float32) + 1
    model = Model([], idf, np.zeros((0, params.features), np.float32), np.zeros(0), params.bits)
    vectors_ = model.vectors(grams)
    parts, least = [], []
    for language in sorted(set(named.tolist())):
        own = vectors_[named == language]
        centers = _clusters(own, params)
        nearest = own @ centers.T
        for i in range(len(centers)):
            mine = nearest[nearest.argmax(1) == i, i]
            least.append(params.slack * float(np.quantile(mine, params.low, method="higher")) if len(mine) else 0.0)
        model.languages += [language] * len(centers)
        parts.append(centers)
    if parts:
        model.centroids, model.least = np.vstack(parts).astype(np.float32), np.array(least)
    return model


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (the key) of every row, and lang_pred, score and rejected.

    lang_pred is the language of the nearest centroid and score their cosine to five places;
    a text that is null, has no letter, or comes before any language is learned is `und`
    with score 0. rejected: und, or farther from the centroid than it allows. Equal texts
    are judged alike, ties go to the first language by name; an empty table gives an empty
    table, other columns are ignored. Columns to keep pass through the task with the text,
    so a filter on the result needs no join.
    """
    keep = keep or [key]
    return _predicted(docs, model, text, keep).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that predict() rejects, whatever its columns are called."""
    rows = _predicted(docs, model, text, docs.columns).where("not rejected")
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def _predicted(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """predict() with the columns to keep named k0, k1, ..."""
    place = keep.index(text) if text in keep else len(keep)
    kinds = dict(docs.dtypes)
    names = [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "rejected"]
    schema = ", ".join(f"k{i} {kinds[c]}" for i, c in enumerate(keep)) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for chunk in chunks(batch.column(place), rows=256):
                likeness = model.vectors(counts(chunk, model.bits)) @ model.centroids.T
                known = has_letters(chunk) & bool(model.languages)
                best = likeness.argmax(1) if model.languages else np.zeros(chunk.n, np.int64)
                score = np.where(known, likeness[np.arange(chunk.n), best], 0) if model.languages else np.zeros(chunk.n)
                rejected = ~known | (score < (model.least[best] if model.languages else 1))
                named = languages[np.where(known, best, len(languages) - 1)]
                kept = [batch.column(i).slice(chunk.first, chunk.n) for i in range(len(keep))]
                found = [pa.array(named.tolist(), pa.string()), pa.array(np.round(np.clip(score, 0, 1).astype(np.float64), 5)), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*kept, *found], names)

    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    return whole_texts(docs).select(*columns, *([] if text in keep else [F.col(text).alias("t")])).mapInArrow(run, schema)
