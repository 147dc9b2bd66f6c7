"""Typed interaction graphs as edge tables (src, dst, type, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import draws
from agora.operators import walks
from agora.operators.ordered import numbered, running
from agora.sources import store


def typed_edges(rows: DataFrame, src: str, dst: str, kind: str, t: str | None, columns: list[str], whole: bool = True) -> DataFrame:
    """Edges of one type; the time column is named unix_createtime, other columns go into attrs. Edges without an end go where `whole`."""
    attrs = F.struct(*columns) if columns else F.struct(F.lit(None).cast("string").alias("none"))
    when = F.col(t) if t else F.lit(None).cast("long")
    out = rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), when.alias("unix_createtime"), F.to_json(attrs).alias("attrs"))
    return out.where("src is not null and dst is not null") if whole else out


def mention_edges(rows: DataFrame, src: str, mentions: str, kind: str, t: str | None, columns: list[str], once: bool) -> DataFrame:
    """An edge for each mention; once: repeated mentions in a row count once."""
    out = rows.where(F.size(mentions) > 0).withColumn("_to", F.explode(mentions))
    if once:
        out = out.dropDuplicates([src, "_to", *([t] if t else []), *columns])
    return typed_edges(out, src, "_to", kind, t, columns)


def reply_edges(rows: DataFrame, author: str, item: str, parent: str, kind: str, t: str | None) -> DataFrame:
    """From a reply's author to the author of the base comment that it answers; replies to replies find none and keep a null end."""
    bases = rows.where(F.col(parent).isNull()).select(F.col(item).alias(parent), F.col(author).alias("_to"))
    replies = rows.where(F.col(parent).isNotNull()).join(bases, parent, "left")
    return typed_edges(replies, author, "_to", kind, t, [item], whole=False)


def share_edges(rows: DataFrame, src: str, shared: str, kind: str, t: str | None, columns: list[str]) -> DataFrame:
    """From who shares to whose content it is; rows that share nothing go."""
    return typed_edges(rows.where(F.col(shared).isNotNull()), src, shared, kind, t, columns)


def graph(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def nodes(edges: DataFrame, *users: DataFrame) -> DataFrame:
    """Users that are given and all ends of edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return reduce(lambda a, b: a.unionByName(b.toDF("node")), users, ends).distinct()


def out_edges(edges: DataFrame, user, kinds: list[str] | None = None) -> DataFrame:
    out = edges.where(F.col("src") == user)
    return out.where(F.col("type").isin(kinds)) if kinds else out


def degree_histogram(edges: DataFrame) -> DataFrame:
    """How many nodes have each degree, by type and over all; parallel edges count, self-loops do not; gaps have 0."""
    rows = edges.where("src <> dst").select("type", F.explode(F.array("src", "dst")).alias("node"))
    rows = rows.select("node", F.explode(F.array("type", F.lit("all"))).alias("type"))
    degrees = rows.groupBy("type", "node").agg(F.count(F.lit(1)).alias("degree"))
    counts = degrees.groupBy("type", "degree").agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("type").agg(F.max("degree").alias("most")).select("type", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("degree"))
    return every.join(counts, ["type", "degree"], "left").na.fill(0, ["n"])


#: Words of 64 users in a row of masks.
WORDS = 16


def _both_ways(edges: DataFrame) -> DataFrame:
    """(node, next) of all undirected edges, once each, without self-loops."""
    rows = edges.where("src <> dst").select("src", "dst")
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().toDF("node", "next")


def _chunks(graph: walks.Packed, nodes: DataFrame, starts: DataFrame, words: int | None = None) -> tuple[DataFrame, DataFrame, str, int]:
    """A row for each chunk of users, a task each; (user, place, id) of users that have an edge, and where they lie; words of a chunk."""
    spark = starts.sparkSession
    users = nodes.toDF("user", "id").join(starts.toDF("user").where("user is not null").distinct(), "user", "left_semi")
    users, at = store.kept(numbered(users, [], [F.col("user")]).select("user", "place", "id"), "users")
    n = users.count()
    words = words or graph.words(n, spark.sparkContext.defaultParallelism)
    chunks = -(-n // (64 * words))
    return spark.range(0, chunks, 1, max(1, chunks)).toDF("chunk"), users, at, words


def _starts(at: str, chunk: int, words: int) -> pd.DataFrame:
    """(user, place, id) of a chunk's users, in order."""
    low = chunk * 64 * words
    return walks.read(at, ["user", "place", "id"], [("place", ">=", low), ("place", "<", low + 64 * words)]).sort_by("place").to_pandas()


def ring_masks(edges: DataFrame, starts: DataFrame, orders: int = 3) -> tuple[DataFrame, DataFrame]:
    """(node, chunk, ring, m0, m1, ...) and (user, chunk, word, bit): the users of a chunk that first reach a node by 1, 2, 3 undirected steps.

    A row stands for up to 64 * WORDS users at once; a task walks with a chunk of them over
    the packed graph, so nothing is shuffled for an edge and a user.
    """
    graph, nodes = walks.packed(edges)
    chunks, users, at, words = _chunks(graph, nodes, starts, WORDS)
    masks = [f"m{k}" for k in range(WORDS)]

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in (c for part in batches for c in part["chunk"]):
            for found in walks.walk(graph, _starts(at, chunk, words)["id"].to_numpy(), words, orders, last=False):
                if isinstance(found, tuple):
                    ring, ids, bits = found
                    yield pd.DataFrame(bits.view(np.int64), columns=masks).assign(id=ids, chunk=chunk, ring=np.int32(ring))

    found = chunks.mapInPandas(walked, f"id int, chunk long, ring int, {', '.join(f'{m} long' for m in masks)}")
    place = F.col("place")
    users = users.select("user", F.floor(place / (64 * words)).alias("chunk"), F.floor(place % (64 * words) / 64).cast("int").alias("word"), (place % 64).cast("int").alias("bit"))
    return found.join(nodes, "id").select("node", "chunk", "ring", *masks), users


def rings(edges: DataFrame, starts: DataFrame, orders: int = 3) -> DataFrame:
    """(user, node, ring): nodes first reached by 1, 2, 3 undirected steps from each user.

    Rings grow with the degree to the power of the order, so starts should be few. Rings of
    one step are edges; farther ones are found by ring_masks() and made pairs at the end.
    """
    if orders == 1:
        return _both_ways(edges).join(starts.toDF("node").distinct(), "node").select(F.col("node").alias("user"), F.col("next").alias("node"), F.lit(1).alias("ring"))
    found, users = ring_masks(edges, starts, orders)
    words = F.array(*[F.col(f"m{k}") for k in range(WORDS)])
    found = found.select("node", "chunk", "ring", F.posexplode(words).alias("word", "m")).where("m <> 0")
    found = found.withColumn("bit", F.explode(F.expr("filter(sequence(0, 63), b -> shiftright(m, b) & 1L = 1L)")))
    return found.join(users, ["chunk", "word", "bit"]).select("user", "node", "ring")


def ring_sizes(edges: DataFrame, starts: DataFrame, orders: int = 3) -> DataFrame:
    """(user, ring, n): how many nodes each ring has; rings without any have no row. Tasks walk and count bits, so neither pairs nor masks leave them."""
    graph, nodes = walks.packed(edges)
    chunks, users, at, words = _chunks(graph, nodes, starts)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in (c for part in batches for c in part["chunk"]):
            own = _starts(at, chunk, words)
            n = np.zeros((orders, 64 * words), np.int64)
            for found in walks.walk(graph, own["id"].to_numpy(), words, orders, last=False):
                if isinstance(found, tuple):
                    n[found[0] - 1] += walks.counted(found[2])
            for k in range(orders):
                yield pd.DataFrame({"user": own["user"], "ring": np.int32(k + 1), "n": n[k, : len(own)]}).query("n > 0")

    return chunks.mapInPandas(sizes, f"user {users.schema['user'].dataType.simpleString()}, ring int, n long")


def capped(rows: DataFrame, keys: list[str], item: Column, cap: int, seed: int = 0) -> DataFrame:
    """At most cap rows of each key, those of smallest hash: the reference sampling of large neighbourhoods."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(draws.uniform(seed, item), item))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def trailing_means(content: DataFrame, asks: DataFrame, keys: list[str], t: str, item: str, value: str, ask: str, at: str, span: int) -> DataFrame:
    """(ask, n, mean) of the content that trailing() gives each ask; asks without any go.

    A window's sum is the difference of two running sums over a key's content in order, and
    its first and last row are found by their places. So an ask costs two rows whatever
    its window holds, and a key that has most rows is dealt over ranges.
    """
    none = F.lit(None)
    rows = content.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.col(item).cast("long").alias("_item"), F.col(value).cast("double").alias("_x"), F.lit(1).cast("long").alias("_one"))
    # Marks stand before all content of their time, or behind it.
    marks = [asks.select(*keys, when.alias("_t"), F.lit(kind).alias("_kind"), F.col(ask).cast("long").alias("_item"), none.cast("double").alias("_x"), F.lit(0).cast("long").alias("_one")) for when, kind in ((F.col(at) - span, 0), (F.col(at), 2))]
    order = [F.col("_t"), F.col("_kind"), F.col("_item")]
    line = running(rows.unionByName(marks[0]).unionByName(marks[1]), keys, order, {"_n": F.col("_one"), "_sum": F.coalesce("_x", F.lit(0.0))})
    line = store.saved(line, "line")
    low, high = (line.where(f"_kind = {k}").select(*keys, F.col("_item").alias(ask), F.col("_n").alias(f"_n{k}"), F.col("_sum").alias(f"_s{k}")) for k in (0, 2))
    both = low.join(high, [*keys, ask]).where("_n2 - _n0 > 2")
    at_place = line.where("_kind = 1").select(*keys, F.col("_n").alias("_place"), "_x")
    for name, place in (("_first", F.col("_n0") + 1), ("_last", F.col("_n2"))):
        both = both.withColumn("_place", place).join(at_place.withColumnRenamed("_x", name), [*keys, "_place"]).drop("_place")
    n = F.col("_n2") - F.col("_n0") - 2
    return both.select(ask, n.alias("n"), ((F.col("_s2") - F.col("_s0") - F.col("_first") - F.col("_last")) / n).alias("mean"))


def trailing(content: DataFrame, asks: DataFrame, keys: list[str], t: str, at: str, span: int) -> DataFrame:
    """Content of the `span` seconds up to each ask, both ends included, less the first and the last row.

    Both are dealt over cells of `span` seconds; an ask looks in its own and the one before.
    """
    cells = asks.withColumn("_cell", F.explode(F.array(F.floor(F.col(at) / span) - 1, F.floor(F.col(at) / span))))
    rows = content.withColumn("_cell", F.floor(F.col(t) / span))
    found = cells.join(rows, [*keys, "_cell"]).where((F.col(t) >= F.col(at) - span) & (F.col(t) <= F.col(at))).drop("_cell")
    ask = [c for c in asks.columns]
    own = Window.partitionBy(*ask)
    rank = F.row_number().over(own.orderBy(t, "item"))
    return found.withColumn("_r", rank).withColumn("_n", F.count(F.lit(1)).over(own)).where("_r > 1 and _r < _n").drop("_r", "_n")
