"""Tables in and out: Parquet scans, CSV with text ids, JSON, dense arrays, graphs."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from agora.functions.text import extract
from agora.sources.staged import MANIFEST, Staged, listed, opened


def scan(spark: SparkSession, paths: list[str], loose: bool = True) -> DataFrame:
    """Parquet files as one table; loose: columns that a file lacks are null, else the columns must agree."""
    if loose:
        return spark.read.option("mergeSchema", True).parquet(*paths)
    columns = {tuple(sorted(spark.read.parquet(p).dtypes)) for p in paths}
    if len(columns) > 1:
        raise ValueError("the files differ in their columns")
    return spark.read.parquet(*paths)


def scan_matching(spark: SparkSession, folder: str, name: str, communities: list[str] | None = None) -> DataFrame:
    """The files of a folder whose names match, as one table, of some communities; columns that a file lacks are null."""
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(folder).where(F.col("_metadata.file_name").rlike(name))
    return rows.where(F.col("subreddit").isin(communities)) if communities else rows


def scan_months(spark: SparkSession, folder: str, first: str, last: str, communities: list[str] | None = None) -> DataFrame:
    """A folder by year_month, pruned to months and communities."""
    rows = spark.read.parquet(folder).where(F.col("year_month").cast("string").between(first, last))
    return rows.where(F.col("subreddit").isin(communities)) if communities else rows


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and given types, so that ids stay text; unnamed index columns go."""
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path, header=True)
    return rows.select(*[c for c in rows.columns if not c.startswith("Unnamed")])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str, codec: str = "zstd", by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)


@dataclass
class _Slice(InputPartition):
    path: str
    start: int
    end: int


class _Arrays(DataSourceReader):
    """Ranges of bytes of each file; a range has the rows that begin in it, as the file's header tells its task."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.split = int(options.get("split", 64 << 20))

    def partitions(self) -> list[_Slice]:
        return [_Slice(p, at, at + self.split) for path in self.paths for p, size in listed(path, ".npy") for at in range(0, size, self.split)]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            (n, width), kind, at = _header(f)
            size = np.dtype(kind).itemsize * width
            first, last = (min(n, max(0, -(-(x - at) // max(size, 1)))) for x in (partition.start, partition.end))
            for k in range(first, last, 4096):
                m = min(4096, last - k)
                f.seek(at + k * size)
                values = np.frombuffer(f.read(m * size), kind).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path.rpartition("/")[2]] * m), pa.array(np.arange(k, k + m)), lists], ["file", "row", "embedding"])


class _ArrayWriter(Staged):
    """Arrays of at most some rows, each with a Parquet file of the keys of its rows."""

    def __init__(self, path: str, overwrite: bool, rows: int):
        super().__init__(path, overwrite)
        self.rows = rows

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                held.append(batch.slice(k, 4096))
                if sum(b.num_rows for b in held) >= self.rows:
                    yield from self._files(held)
                    held = []
        if sum(b.num_rows for b in held):
            yield from self._files(held)

    def _files(self, held: list[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        keys = pa.chunked_array([b.column(0) for b in held])
        values = np.array([v for b in held for v in b.column(1).to_pylist()], np.float64)
        name, content = self.name(".npy"), io.BytesIO()
        np.save(content, values)
        yield name, len(values), content.getvalue()
        table = io.BytesIO()
        pq.write_table(pa.table({"file": [name] * len(values), "row": np.arange(len(values)), "key": keys}), table)
        yield name.replace(".npy", ".keys.parquet"), len(values), table.getvalue()


class NpyRows(DataSource):
    """format("npy_rows"): rows of dense two-dimensional arrays in C order; path is a file or folder, option files a JSON list of such.

    Reading, option split is the bytes of a task. Writing takes (key, embedding), with equal
    sizes of all vectors, and option rows is the most of a file.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "file string, row long, embedding array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Arrays(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _ArrayWriter:
        return _ArrayWriter(self.options["path"], overwrite, int(self.options.get("rows", 65_536)))


def read_npy(spark: SparkSession, files: str | list[str], split: int = 64 << 20) -> DataFrame:
    """(file, row, embedding) of dense two-dimensional arrays, of files or folders; a task reads some bytes of a file."""
    spark.dataSource.register(NpyRows)
    return spark.read.format("npy_rows").option("files", json.dumps([files] if isinstance(files, str) else files)).option("split", split).load()


def _header(f) -> tuple[tuple[int, int], np.dtype, int]:
    version = np.lib.format.read_magic(f)
    shape, order, kind = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](f)
    if len(shape) != 2 or order:
        raise ValueError("only two-dimensional arrays in C order are read")
    return shape, kind, f.tell()


def write_npy(rows: DataFrame, key: str, embedding: str, path: str, size: int = 65_536) -> None:
    """Embeddings as .npy files of a folder and the keys of their rows beside them, all of them or none."""
    rows.sparkSession.dataSource.register(NpyRows)
    rows.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("embedding")).write.format("npy_rows").option("rows", size).mode("append").save(path)


def npy_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, row, key) of the arrays that finished jobs have written to a folder."""
    done = spark.read.parquet(f"{path}/{MANIFEST}").where(F.col("file").endswith(".keys.parquet")).select(F.replace("file", F.lit(".keys.parquet"), F.lit(".npy")).alias("file"))
    keys = spark.read.parquet(f"{path}/*.keys.parquet").withColumnRenamed("key", key)
    return keys.join(done, "file", "left_semi")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in any store that Spark writes to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(content))
    out.close()


def node_link(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """A graph as two folders of JSON lines, nodes and links, as node-link documents name them."""
    write_json(nodes.select(F.col("node").alias("id")), f"{path}/nodes")
    write_json(edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")]), f"{path}/links")


def read_node_link(spark: SparkSession, path: str, links: str, node: str = "id string") -> tuple[DataFrame, DataFrame]:
    edges = spark.read.schema(links).json(f"{path}/links").withColumnsRenamed({"source": "src", "target": "dst"})
    return edges, spark.read.schema(node).json(f"{path}/nodes").withColumnRenamed("id", "node")


def json_row(*columns: str, lists: tuple[str, ...] = ()) -> Column:
    """A row as JSON text, with lists joined by commas."""
    return F.to_json(F.struct(*columns, *[F.array_join(c, ",").alias(c) for c in lists]))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Metrics files of runs, <topic>/<run>/metrics_<rows>.json, with both names and the number of rows in the file's name."""
    rows = spark.read.option("multiLine", True).json(f"{path}/*/*/metrics*.json").withColumn("_path", F.col("_metadata.file_path"))
    part = F.split("_path", "/")
    rows = rows.withColumn("topic", F.element_at(part, -3)).withColumn("run", F.element_at(part, -2))
    return rows.withColumn("num_comments", extract(F.element_at(part, -1), r"_(\d+)\.json$").cast("long")).drop("_path")
