"""Walks from many users at once over a graph that is packed once and lies in the shared folder.

A graph's nodes are numbered and its neighbours packed in blocks of about EDGES each. Tasks
read the blocks one after another, as often as a walk has steps; no row is made or shuffled
for an edge, a step and a user. A task holds a row of bits for each node that its users
reach, and a few numbers for each node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.ordered import numbered
from agora.sources import store
from agora.sources.staged import located

#: Neighbours of a block, about; a block's nodes are not cut.
EDGES = 1 << 16
#: Edges that a task packs before it sends them on.
HELD = 1 << 21
#: Bytes of the rows of bits that a task holds, at most, as long as a word for each node and step is less.
HELD_BITS = 512 << 20
_BLOCK = "block int, n int, size int, data binary"


def _pack(a: np.ndarray, b: np.ndarray) -> tuple[int, int, bytes]:
    """Of pairs in order: their number, and steps between first ends and between second ends, whose high bytes are runs of zeros."""
    rows = np.concatenate([np.diff(x.astype(np.int32), prepend=np.int32(0)) for x in (a, b)]).astype("<i4")
    data = np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), 4).T).tobytes()
    return len(a), len(data), pa.compress(data, "zstd", asbytes=True)


def _unpack(n: int, size: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8).reshape(4, -1)
    rows = np.ascontiguousarray(planes.T).view("<i4").ravel()
    return np.cumsum(rows[:n], dtype=np.int32), np.cumsum(rows[n:], dtype=np.int32)


def read(path: str, columns: list[str], filters: list | None = None) -> pa.Table:
    """Columns of a table of the shared folder, in a task."""
    where, name = located(path)
    return pq.read_table(name, filesystem=where, columns=columns, filters=filters).combine_chunks()


def _lists(keys: np.ndarray) -> tuple[int, int, bytes]:
    """Of pairs a << 32 | b in order: how many a there are and how many pairs; the a, their numbers of b, and all b, which are quickly read."""
    a = keys >> 32
    cuts = np.flatnonzero(np.diff(a, prepend=-1))
    return len(cuts), len(keys), np.concatenate([a[cuts], np.diff(cuts, append=len(a)), keys & 0xFFFFFFFF]).astype("<i4").tobytes()


@dataclass
class Packed:
    """Where the blocks of a graph lie; its nodes are 0 to size - 1."""

    path: str
    size: int

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes, their numbers of neighbours, and all neighbours, of each block."""
        where, name = located(self.path)
        for f in sorted(f.path for f in where.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".parquet")):
            with where.open_input_file(f) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=1, columns=["n", "data"]):
                    for n, data in zip(*batch.columns, strict=True):
                        yield tuple(np.split(np.frombuffer(data.as_buffer(), "<i4"), [n.as_py(), 2 * n.as_py()]))

    def words(self, users: int, tasks: int, most: int = 16, steps: int = 1) -> int:
        """How many words of 64 users a task walks with, if it holds `steps` steps: few enough for all tasks to have some, and for memory."""
        return int(max(1, min(most, HELD_BITS // (8 * steps * max(1, self.size)), -(-users // (64 * max(1, tasks))))))


def packed(edges: DataFrame) -> tuple[Packed, DataFrame]:
    """The undirected graph of edges (src, dst), each once, without self-loops and missing ends; and its nodes (node, id)."""
    rows = store.saved(edges.where("src <> dst").select("src", "dst"), "edges")
    nodes, names = store.kept(numbered(rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), [], [F.col("node")], "id").select("node", F.col("id").cast("int").alias("id")), "nodes")
    size, count = nodes.count(), rows.count()
    parts = max(1, -(-2 * count // EDGES))

    def ids() -> pa.Array:
        table = read(names, ["node", "id"])
        return table.column("node").combine_chunks().take(pc.sort_indices(table.column("id")))

    def sent(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        keys = np.concatenate([(a << 32) | b, (b << 32) | a])
        block = (keys >> 32) % parts
        order = np.lexsort([keys, block])
        keys, block = keys[order], block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        out = [(int(block[lo]), *_pack(keys[lo:hi] >> 32, keys[lo:hi] & 0xFFFFFFFF)) for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "n", "size", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, held = None, [], 0

        def flushed() -> pa.RecordBatch:
            ends = [pa.concat_arrays([w.column(k) for w in waiting]) for k in (0, 1)]
            return sent(*(pc.index_in(x, value_set=known.cast(x.type)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ends))

        for batch in batches:
            if batch.num_rows:
                known = ids() if known is None else known
                waiting.append(batch)
                held += batch.num_rows
                if held >= HELD:
                    yield flushed()
                    waiting, held = [], 0
        if held:
            yield flushed()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        found = [_unpack(*x) for x in zip(part["n"], part["size"], part["data"], strict=True)]
        keys = np.unique(np.concatenate([(a.astype(np.int64) << 32) | b for a, b in found]))
        n, size, data = _lists(keys)
        return pd.DataFrame({"block": part["block"].head(1), "n": [n], "size": [size], "data": [data]})

    _, path = store.kept(rows.mapInArrow(pack, _BLOCK).groupBy("block").applyInPandas(merge, _BLOCK), "graph")
    return Packed(path, size), nodes


@dataclass
class Step:
    """The nodes that are first reached by one step: their ids, their rows of bits, and the row of each node or -1."""

    ids: np.ndarray
    bits: np.ndarray
    row: np.ndarray


def _bits(starts: np.ndarray, size: int, words: int) -> Step:
    """Step 0: the k-th start has bit k."""
    ids, of = np.unique(starts, return_inverse=True)
    bits, k = np.zeros((len(ids), words), np.uint64), np.arange(len(starts))
    np.bitwise_or.at(bits, (of, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    row = np.full(size, -1, np.int32)
    row[ids] = np.arange(len(ids))
    return Step(ids, bits, row)


def _met(to: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node once and in order, with all its bits."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    return to[cuts], np.bitwise_or.reduceat(bits.take(order, axis=0), cuts, axis=0) if len(cuts) else bits


def _pushed(graph: Packed, before: Step) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, bits) next to those of a step that has few nodes, all at once."""
    to, bits, waiting = np.zeros(0, np.int32), before.bits[:0], []
    for nodes, counts, near in graph.blocks():
        at = before.row.take(nodes)
        if (at >= 0).any():
            at = np.repeat(at, counts)
            held = np.flatnonzero(at >= 0)
            waiting.append((near[held], at[held]))
        if sum(len(x) for x, _ in waiting) > EDGES:
            to, bits = _met(np.concatenate([to, *[x for x, _ in waiting]]), np.concatenate([bits, *[before.bits.take(x, axis=0) for _, x in waiting]]))
            waiting = []
    yield _met(np.concatenate([to, *[x for x, _ in waiting]]), np.concatenate([bits, *[before.bits.take(x, axis=0) for _, x in waiting]]))


def _pulled(graph: Packed, before: Step) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, bits) next to those of a step, a block's at a time."""
    for nodes, counts, near in graph.blocks():
        at = before.row.take(near)
        held = np.flatnonzero(at >= 0)
        if len(held):
            of = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)[held]
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            yield nodes[of[cuts]], np.bitwise_or.reduceat(before.bits.take(at[held], axis=0), cuts, axis=0)


def walk(graph: Packed, starts: np.ndarray, words: int, orders: int, last: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray] | Step]:
    """(ring, nodes, bits) of the nodes that starts first reach by 1, 2, ... steps, some at a time; behind each ring its whole Step, that of the last one if `last`."""
    steps = [_bits(starts, graph.size, words)]
    for k in range(1, orders + 1):
        hold = k < orders or last
        if hold:  # memory is taken as rows are filled
            ids, bits, row, filled = np.empty(graph.size, np.int32), np.empty((graph.size, words), np.uint64), np.full(graph.size, -1, np.int32), 0
        for to, new in (_pushed if k == 1 else _pulled)(graph, steps[-1]):
            for s in steps:
                old = s.row.take(to)
                known = np.flatnonzero(old >= 0)
                new[known] &= ~s.bits.take(old[known], axis=0)
            some = new.any(axis=1)
            to, new = (to, new) if some.all() else (to[some], new[some])
            if len(to):
                yield k, to, new
                if hold:
                    ids[filled : filled + len(to)], bits[filled : filled + len(to)] = to, new
                    row[to] = np.arange(filled, filled + len(to))
                    filled += len(to)
        if hold:
            steps.append(Step(ids[:filled], bits[:filled], row))
            yield steps[-1]


def counted(bits: np.ndarray) -> np.ndarray:
    """How many rows have each bit."""
    out = np.zeros(64 * bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):  # as many as a byte counts
        out += np.unpackbits(np.ascontiguousarray(bits[at : at + 255]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return out
