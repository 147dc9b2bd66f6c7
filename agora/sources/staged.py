"""Files of any store that Arrow knows: opened, listed, and written by tasks so that a job shows all or none of them."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

#: Where jobs note their files, in a folder that was written here.
MANIFEST = "manifest"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    """A file opened to be read."""
    where, name = located(path)
    return where.open_input_file(name)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files of a folder that end so, or of a single file.

    In a folder with a manifest these are the files of finished jobs; others are left over.
    """
    where, name = located(path)
    head = path[: len(path) - len(name)] if path.endswith(name) else path[: path.index(":") + 1] + "//"
    one = where.get_file_info(name)
    if one.type == fs.FileType.File:
        return [(path, one.size)]
    found = where.get_file_info(fs.FileSelector(name, allow_not_found=True))
    out = {f.base_name: (head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix)}
    if any(f.base_name == MANIFEST for f in found):
        notes = where.get_file_info(fs.FileSelector(f"{name}/{MANIFEST}"))
        done = {n for f in notes if f.base_name.endswith(".parquet") for n in pq.read_table(f.path, filesystem=where, columns=["file"]).column("file").to_pylist()}
        out = {n: x for n, x in out.items() if n in done}
    return [out[n] for n in sorted(out)]


@dataclass
class Wrote(WriterCommitMessage):
    """What a task has staged: (file, rows, bytes)."""

    files: list[tuple[str, int, int]]


class Staged(DataSourceArrowWriter):
    """Tasks write files of names of their own to a folder beside the target; a finished job moves them into it.

    The manifest, one small Parquet file for each job, comes last: from then on listed()
    shows the job's files. Of a task that ran twice only the attempt that counted is moved;
    the folder goes with the rest, and so it does if the job fails. A task's message has a
    row for each of its files.
    """

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    @property
    def stage(self) -> str:
        return f"{located(self.path)[1]}/_{self.job}"

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        """A task's files: suffix, rows and bytes. One after another, so a task holds one."""
        raise NotImplementedError

    def name(self, suffix: str) -> str:
        return f"{self.job[:12]}-{uuid.uuid4().hex}{suffix}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        where, _ = located(self.path)
        where.create_dir(self.stage)
        out = []
        for suffix, rows, content in self.contents(iterator):
            name = suffix if not suffix.startswith(".") else self.name(suffix)
            with where.open_output_stream(f"{self.stage}/{name}", compression=None) as f:
                f.write(content)
            out.append((name, rows, len(content)))
        return Wrote(out)

    def commit(self, messages: list[Wrote | None]) -> None:
        where, folder = located(self.path)
        where.create_dir(f"{folder}/{MANIFEST}")
        old = [f for f in where.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
        notes = where.get_file_info(fs.FileSelector(f"{folder}/{MANIFEST}"))
        files = [f for m in messages if m for f in m.files]
        for name, _, _ in files:
            where.move(f"{self.stage}/{name}", f"{folder}/{name}")
        buffer = io.BytesIO()
        pq.write_table(pa.table({"file": pa.array([f[0] for f in files], pa.string()), "rows": pa.array([f[1] for f in files], pa.int64()), "bytes": pa.array([f[2] for f in files], pa.int64())}), buffer)
        with where.open_output_stream(f"{folder}/{MANIFEST}/{self.job}.parquet", compression=None) as f:
            f.write(buffer.getvalue())
        for f in [*notes, *old] if self.overwrite else []:
            where.delete_file(f.path)
        self._clear(where)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear(located(self.path)[0])

    def _clear(self, where: fs.FileSystem) -> None:
        if where.get_file_info(self.stage).type == fs.FileType.Directory:
            where.delete_dir(self.stage)
