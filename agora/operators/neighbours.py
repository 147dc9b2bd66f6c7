"""Nearest neighbours by inverted lists around pivots, with bounds that make the search exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.sources.store import saved


def clean(column: str | Column) -> Column:
    """A vector of doubles, with 0 for null and NaN."""
    return F.transform(column, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def unit(column: str | Column) -> Column:
    """A vector of length 1, as euclidean neighbours of those are cosine's; zero vectors stay."""
    v = clean(column)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


@dataclass
class Index:
    """Pivots, and the table of all rows by the list of their nearest pivot.

    pivots (lists x dims), with the least and largest distance of a row in each list and
    its number of blocks. rows has (list, block, id, e); a block has about `block` rows
    whatever the size of its list, so a crowded place is many tasks. The lists' number grows
    with the rows up to `most` / dims, which bounds what is broadcast.
    """

    pivots: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    blocks: np.ndarray
    rows: DataFrame
    block: int


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def smallest(d: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least of each row in order, of equal ones the first; for few of many this is less than a sort."""
    k = min(k, d.shape[1])
    if k > 16:
        return np.argsort(d, 1, kind="stable")[:, :k]
    d, out, row = d.copy(), np.empty((len(d), k), np.intp), np.arange(len(d))
    for i in range(k):
        out[:, i] = d.argmin(1)
        d[row, out[:, i]] = np.inf
    return out


def build(rows: DataFrame, key: str = "id", embedding: str = "e", block: int = 2048, most: int = 1 << 23) -> Index:
    """An index of every row with a vector; vectors are of equal size and already clean.

    Pivots are rows drawn by hash of their key, one for each `block` rows. Keys are longs
    and unique.
    """
    table = saved(rows.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e")).where("e is not null and size(e) > 0"), "vectors")
    size, dims = table.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
    lists = int(max(1, min(-(-size // block), most // (dims or 1))))
    # A share with more than twice the rows wanted has them for certain.
    share = min(1 << 20, (2 * lists + 64) * (1 << 20) // max(size, 1) + 1)
    drawn = table.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    found = drawn.orderBy(F.xxhash64("id"), "id").limit(lists).select("e").toArrow().column("e").combine_chunks()
    pivots = np.asarray(found.flatten(), float).reshape(-1, dims or 1)

    def place(batches):
        for part in batches:
            e = np.stack(part["e"].to_numpy()) if len(part) else np.zeros((0, pivots.shape[1]))
            d = distances(e, pivots)
            best = d.argmin(1)
            yield part.assign(list=best, d=d[np.arange(len(e)), best])

    placed = saved(table.mapInPandas(place, "id long, e array<double>, list long, d double"), "placed")
    sizes = {r.list: (r.lo, r.hi, r.n) for r in placed.groupBy("list").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    lo, hi, n = (np.array([sizes.get(i, (0.0, -1.0, 0))[k] for i in range(len(pivots))], float) for k in range(3))
    blocks = -(-n.astype(int) // block)
    table_of = rows.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(blocks)], "list long, blocks int")
    dealt = placed.join(F.broadcast(table_of), "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "e")
    return Index(pivots, lo, hi, blocks, dealt, block)


def _search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, item, d): the k nearest of each query (list, id, e) in each block of the lists that it asks.

    A block that many queries ask is met by them in groups, so both sides of a task are bounded.
    """
    blocks = asked.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(index.blocks)], "list long, blocks int")
    askers = asked.groupBy("list").agg(F.count(F.lit(1)).alias("askers"))
    plan = saved(askers.join(F.broadcast(blocks), "list").where("blocks > 0").select("list", "blocks", F.ceil(F.col("askers") / index.block).cast("int").alias("parts")), "plan")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    queries = asked.join(F.broadcast(plan), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("list", every("blocks").alias("block"), "part", "id", "e")
    items = index.rows.join(F.broadcast(plan.drop("blocks")), "list").select("list", "block", every("parts").alias("part"), "id", "e")

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "item": np.zeros(0, np.int64), "d": np.zeros(0)})]
        if len(q) and len(r):
            a, b, ids, items = np.stack(q["e"].to_numpy()), np.stack(r["e"].to_numpy()), q["id"].to_numpy(), r["id"].to_numpy()
            for at in range(0, len(a), 512):
                some = distances(a[at : at + 512], b)
                some[ids[at : at + 512, None] == items[None, :]] = np.inf
                # What rounding may have put beyond the k-th is measured again, by differences.
                limit = np.partition(some, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] + 1e-6
                row, near = np.nonzero((some <= limit[:, None]) & np.isfinite(some))
                # Copies can be all of a block, so differences are taken of some at a time.
                d = np.concatenate([np.sqrt(((b[near[i : i + 65536]] - a[at + row[i : i + 65536]]) ** 2).sum(1)) for i in range(0, max(len(row), 1), 65536)]).round(12)
                order = np.lexsort((items[near], d, row))
                row, near, d = row[order], near[order], d[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"query": ids[at + row[best]], "item": items[near[best]], "d": d[best]}))
        return pd.concat(out)

    key = ["list", "block", "part"]
    return queries.groupBy(*key).cogroup(items.groupBy(*key)).applyInPandas(meet, "query long, item long, d double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "item"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, k: int, key: str = "id", embedding: str = "e", probes: int = 4) -> DataFrame:
    """(query, item, d, rank): the k nearest rows of each query by euclidean distance, itself left out; ties by id.

    A query first asks the lists of its nearest pivots, which bounds the distance of its k-th
    neighbour. It then asks only the lists that may hold one as near: a row of a list is
    no nearer than the query's distance to the pivot less the list's farthest, than the
    list's nearest less that distance, and than half of what the pivot is farther away
    than the query's own. So the result is that of a full search. What the bounds leave
    out depends on the data: with clusters a query asks few lists, however many there are;
    vectors without any structure are all equally far, and every list is asked.
    """
    asked = saved(queries.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e")).where("e is not null and size(e) > 0"), "queries")
    pivots, lo, hi, held = index.pivots, index.nearest, index.farthest, np.flatnonzero(index.blocks > 0)

    def first(batches):
        for part in batches:
            d = distances(np.stack(part["e"].to_numpy()), pivots)[:, held] if len(part) else np.zeros((0, len(held)))
            lists = smallest(d, probes)
            yield pd.DataFrame({"list": held[lists.ravel()], "id": np.repeat(part["id"].to_numpy(), lists.shape[1]), "e": list(np.repeat(part["e"].to_numpy(), lists.shape[1]))})

    def rest(batches):
        for part in batches:
            if not len(part):
                continue
            d = distances(np.stack(part["e"].to_numpy()), pivots)[:, held]
            done = np.zeros(d.shape, bool)
            np.put_along_axis(done, smallest(d, probes), True, 1)
            least = np.maximum.reduce([d - hi[held], lo[held] - d, (d - d.min(1, keepdims=True)) / 2])
            row, col = np.nonzero(~done & (least <= part["most"].to_numpy()[:, None] + 1e-6))
            yield pd.DataFrame({"list": held[col], "id": part["id"].to_numpy()[row], "e": part["e"].to_numpy()[row]})

    schema = "list long, id long, e array<double>"
    near = saved(_best(_search(index, asked.mapInPandas(first, schema), k), k), "near")
    most = near.groupBy("query").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"))
    most = most.select(F.col("query").alias("id"), F.when(F.col("n") >= k, F.col("d")).alias("most"))
    left = asked.join(most, "id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    more = _search(index, saved(left.mapInPandas(rest, schema), "asked"), k)
    return _best(near.drop("rank").unionByName(more), k)
