"""Dumps of posts: compressed lines of JSON to monthly Parquet, each file once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from agora.sources.staged import Staged, listed, opened

COMMENT = "author string, author_fullname string, body string, created_utc long, id string, parent_id string, permalink string, score long, subreddit string"
SUBMISSION = "author string, author_fullname string, title string, selftext string, created_utc long, id string, num_comments long, permalink string, score long, subreddit string"
#: Fixed value: the largest window of the compressed dumps, in bytes.
WINDOW = 2**31


#: Fixed values of the format: what begins a frame, and a range of what begins one to skip.
FRAME, SKIPPED = 0xFD2FB528, range(0x184D2A50, 0x184D2A60)


def frame_end(f, at: int, size: int) -> int | None:
    """Where the frame ends that begins at a place of a file; None if none does or it is cut off.

    The headers of a frame's blocks tell their sizes, so nothing is decompressed.
    """
    f.seek(at)
    head = f.read(8)
    magic = int.from_bytes(head[:4], "little")
    if len(head) == 8 and magic in SKIPPED:
        end = at + 8 + int.from_bytes(head[4:], "little")
        return end if end <= size else None
    if len(head) < 6 or magic != FRAME:
        return None
    flags = head[4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    if flags >> 3 & 1:  # reserved
        return None
    length = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + length
    last = 0
    while not last:
        f.seek(at)
        block = f.read(3)
        value = int.from_bytes(block, "little")
        last, kind = value & 1, value >> 1 & 3
        at += 3 + (1 if kind == 1 else value >> 3)
        if len(block) < 3 or kind == 3 or at > size:
            return None
    at += 4 * checksum
    return at if at <= size else None


class _Bytes:
    """What a file holds from a place up to another, to be read once."""

    def __init__(self, f, at: int, end: int):
        f.seek(at)
        self.f, self.left = f, end - at

    def read(self, n: int) -> bytes:
        some = self.f.read(min(n, self.left))
        self.left -= len(some)
        return some


def contents(f, at: int, end: int) -> Iterator[bytes]:
    """What a frame holds, in pieces; of a frame that is cut off, what is there."""
    import zstandard

    with zstandard.ZstdDecompressor(max_window_size=WINDOW).stream_reader(_Bytes(f, at, end), read_across_frames=False, closefd=False) as frame:
        while piece := frame.read(1 << 20):
            yield piece


def _opens(f, at: int, end: int) -> bool:
    import zstandard

    try:
        next(contents(f, at, end), None)
    except zstandard.ZstdError:
        return False
    return True


def first_frame(f, at: int, end: int, size: int) -> int | None:
    """The first place from at, before end, where a frame begins.

    Four bytes inside a frame may look like a beginning; a real one has whole blocks up to
    its end, and there another frame or nothing, and can be decompressed.
    """
    step = 1 << 20
    while at < end:
        f.seek(at)
        some = f.read(min(step, end - at) + 3)
        k = -1
        while (k := _magic(some, k + 1)) >= 0 and at + k < end:
            stop = frame_end(f, at + k, size)
            if stop is not None and (stop == size or _begins(f, stop)) and _opens(f, at + k, stop):
                return at + k
        at += step
    return None


def _begins(f, at: int) -> bool:
    f.seek(at)
    magic = int.from_bytes(f.read(4), "little")
    return magic == FRAME or magic in SKIPPED


def _magic(some: bytes, start: int) -> int:
    found = [k for k in (some.find(FRAME.to_bytes(4, "little"), start), some.find(b"\x2a\x4d\x18", start + 1) - 1) if k >= start]
    return min(found, default=-1)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class _Reader(DataSourceReader):
    """Ranges of bytes of each file; a range has the lines that begin in frames that begin in it.

    A line may run on over any number of frames. So a range leaves out what it has up to
    its first line feed, which belongs to an earlier one, and reads on behind its end up to
    the first line feed there. A file of a single frame is one task, as nothing in it tells
    where to begin.
    """

    def __init__(self, options: dict):
        paths = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.paths, self.split = paths, int(options.get("split", 64 << 20))

    def partitions(self) -> list[_Range]:
        files = [f for p in self.paths for f in listed(p, ".zst")]
        return [_Range(p, at, min(at + self.split, size), size) for p, size in files for at in range(0, size, self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for line in _lines(partition):
            some.append(line.decode("utf-8", "replace").rstrip("\r"))
            size += len(line)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["line"])
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["line"])


def _lines(part: _Range) -> Iterator[bytes]:
    with opened(part.path) as f:
        at = first_frame(f, part.start, part.end, part.size)
        if at is None and part.start == 0:
            at = 0  # one frame that is cut off: its whole lines can still be read
        if at is None:
            return
        inside, rest = at == 0, []  # inside: a line of this range has begun
        while at < part.size:
            stop = frame_end(f, at, part.size)
            # No range finds a last frame that is cut off; it goes with the one before.
            beyond = at >= part.end and stop is not None
            if beyond and not inside:
                return
            for piece in contents(f, at, part.size if stop is None else stop):
                first, *more = piece.split(b"\n")
                rest.append(first)
                if more:
                    if inside:
                        yield b"".join(rest)
                    if beyond:
                        return
                    inside = True
                    yield from more[:-1]
                    rest = [more[-1]]
                elif not inside:
                    rest = []
            at = part.size if stop is None else stop
        if inside and any(rest):
            yield b"".join(rest)


class _Writer(Staged):
    """One file for each task, in frames of about a size, so that it can be read in parts."""

    def __init__(self, path: str, overwrite: bool, frame: int):
        super().__init__(path, overwrite)
        self.frame = frame

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        import zstandard

        rows, whole, some, size = 0, [], [], 0

        def close() -> None:
            nonlocal some, size
            if some:
                whole.append(zstandard.ZstdCompressor().compress(b"".join(some)))
            some, size = [], 0

        for batch in batches:
            for line in batch.column(0).to_pylist():
                if line is not None:
                    some.append(line.encode() + b"\n")
                    rows, size = rows + 1, size + len(some[-1])
                if size >= self.frame:
                    close()
                if sum(map(len, whole)) >= 1 << 28:
                    yield ".zst", rows, b"".join(whole)
                    rows, whole = 0, []
        close()
        if whole:
            yield ".zst", rows, b"".join(whole)


class ZstdLines(DataSource):
    """format("zstd_lines"): the lines of compressed files; path is a file or folder, option files a JSON list of such.

    Reading, option split is the bytes of a task. Writing, frame is about the bytes of a frame.
    """

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, int(self.options.get("frame", 4 << 20)))


def read_zstd(spark: SparkSession, files: str | list[str], schema: str = COMMENT, split: int = 64 << 20) -> DataFrame:
    """Rows of compressed lines of JSON, of files or folders; lines that are cut off or no objects go, numbers may be written as text."""
    spark.dataSource.register(ZstdLines)
    lines = spark.read.format("zstd_lines").option("files", json.dumps([files] if isinstance(files, str) else files)).option("split", split).load()
    fields = [f.split(" ") for f in schema.split(", ")]
    # Text takes a value of any kind; a cast then gives the numbers.
    loose = ", ".join(f"{name} string" for name, _ in fields) + ", _cut string"
    rows = lines.select(F.from_json("line", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_cut"}).alias("r")).where("r is not null and r._cut is null")
    kinds = [F.col(f"r.{name}").try_cast("double").cast("long").alias(name) if kind == "long" else F.col(f"r.{name}").alias(name) for name, kind in fields]
    return rows.select(*kinds)


def write_zstd(lines: DataFrame, path: str, frame: int = 4 << 20) -> None:
    """A column of lines as compressed files of a folder, all of them or none; null lines go."""
    lines.sparkSession.dataSource.register(ZstdLines)
    lines.toDF("line").write.format("zstd_lines").option("frame", frame).mode("append").save(path)


def in_scope(rows: DataFrame, communities: list[str], tombstones: tuple[str, ...] = ("[deleted]", "[removed]"), text: str = "body") -> DataFrame:
    """Rows of the communities whose text is not a tombstone; null texts go too."""
    return rows.where(F.col("subreddit").isin(communities) & ~F.col(text).isin(*tombstones))


def month_of(seconds: str) -> Column:
    """The month in UTC of seconds since 1970, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(seconds) / 86_400).cast("int")), "yyyy-MM")


def write_monthly(rows: DataFrame, path: str, codec: str = "zstd") -> None:
    """Parquet by month of creation; months that are written again are replaced."""
    (rows.withColumn("year_month", month_of("created_utc")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy("year_month").parquet(path))


def unprocessed(inputs: DataFrame, done: DataFrame, key: str = "year_month") -> DataFrame:
    """Inputs whose key has no output yet."""
    return inputs.join(done, key, "left_anti")


def stream_json(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Every new JSON file of a folder, once, to Parquet by month; stops when all that is there is done."""
    rows = spark.readStream.schema(schema).json(folder).withColumn("year_month", month_of("created_utc"))
    rows.writeStream.format("parquet").partitionBy("year_month").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
