"""Near duplicates by HyperMinHash registers, banding and a check on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.components import components
from agora.llm.scratch import save, shuffle_partitions, whole_texts
from agora.llm.textarrays import FOLDED, Chunk, Windows, chunks, first_of_each, hashes_of, mix, word_numbers

#: A register keeps, of the smallest hash in its bucket, the number of leading zeros and
#: MANTISSA bits after the leading one. 0 is an empty bucket.
BUCKET_BITS, MANTISSA = 8, 10
BUCKETS = 1 << BUCKET_BITS


@dataclass(frozen=True)
class Params:
    """Words in a shingle, the least similarity in hundredths, registers in a band; rows and shingles of a block.

    With 42 bands of 6 registers, a pair at similarity 0.8 shares none with probability
    (1 - 0.8**6)**42 = 3e-6; below 256 shingles buckets hold one shingle each and the
    bands of all others agree, so small texts are surer still. Blocks bound what one task
    holds: block rows, or about shingles of them where texts are long.
    """

    shingle: int = 5
    percent: int = 80
    band: int = 6
    block: int = 2048
    shingles: int = 1 << 20

    @property
    def bands(self) -> int:
        return BUCKETS // self.band


@dataclass
class Sets:
    """The shingle sets of some texts: entries of text i stand at at[i] to at[i + 1].

    `hashes` (2 x entries) tell shingles apart across tasks, the first row in rising order
    within a text. `numbers` tell them apart exactly, among the texts of one Sets.
    """

    hashes: np.ndarray
    numbers: np.ndarray
    at: np.ndarray

    def exact(self) -> list[np.ndarray]:
        return [np.sort(self.numbers[i:j]) for i, j in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]


def shingle_sets(chunk: Chunk, width: int) -> Sets:
    starts, ends, first = chunk.words()
    numbers, kinds = word_numbers(FOLDED[chunk.data], starts, ends)
    windows = Windows(numbers, len(kinds), first, width)
    owner, exact = windows.owners(), windows.numbers()
    kept = first_of_each(owner, exact)
    hashes = np.stack([windows.hashes(h)[kept] for h in hashes_of(kinds)]) if len(kinds) else np.zeros((2, 0), np.uint64)
    at = np.zeros(chunk.n + 1, np.int64)
    np.cumsum(np.bincount(owner[kept], minlength=chunk.n), out=at[1:])
    order = np.lexsort((hashes[0], owner[kept]))
    return Sets(hashes[:, order], exact[kept][order], at)


def sets_of(column: pa.Array, width: int) -> Sets:
    """The sets of all texts of a column together, so that their numbers compare."""
    parts = list(chunks(column, size=1 << 62, rows=1 << 62))
    return shingle_sets(parts[0], width) if parts else Sets(np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64))


def similar_sets(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of rising distinct numbers; never for empty sets."""
    if not len(u) or not len(v):
        return False
    if len(u) > len(v):
        u, v = v, u
    shared = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
    return shared * 100 >= percent * (len(u) + len(v) - shared)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The registers (texts x BUCKETS, 16 bits) of distinct rising hashes of each text."""
    out = np.zeros((len(at) - 1, BUCKETS), np.uint16)
    if not len(hashes):
        return out
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    place = doc * BUCKETS + bucket
    head = np.ones(len(place), bool)
    head[1:] = place[1:] != place[:-1]
    smallest = (hashes[head] << np.uint64(BUCKET_BITS)) | np.uint64(1)
    # Leading zeros of a 64-bit number, by its halves: each half is exact as a double.
    high, low = (smallest >> np.uint64(32)).astype(np.float64), (smallest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    zeros = np.minimum(64 - bits, 62).astype(np.uint64)
    after = (smallest << zeros) << np.uint64(1)
    out.reshape(-1)[place[head]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | after >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return out


def sketch(rows: DataFrame, params: Params) -> DataFrame:
    """row, id, number of shingles, two checksums of the set and its registers, of (row, id, text)."""
    schema = "row long, id long, n_shingles long, set1 long, set2 long, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = shingle_sets(chunk, params.shingle)
                total = np.zeros((2, len(found.numbers) + 1), np.uint64)
                np.cumsum(mix(found.hashes), axis=1, out=total[:, 1:])
                sums = (total[:, found.at[1:]] - total[:, found.at[:-1]]).view(np.int64)
                raw = pa.array([r.tobytes() for r in registers(found.hashes[0], found.at).astype("<u2")], pa.binary())
                own = [batch.column(i).slice(chunk.first, chunk.n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(found.at)), pa.array(sums[0]), pa.array(sums[1]), raw], ["row", "id", "n_shingles", "set1", "set2", "registers"])

    return whole_texts(rows).select("row", "id", "text").mapInArrow(run, schema)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from registers, less the matches that unequal shingles give by chance.

    Two different smallest hashes share leading zeros and mantissa with a probability
    near 2**-MANTISSA / 3: sum over z of (2**-(z+1))**2 * 2**-MANTISSA.
    """
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    chance = used * 2.0**-MANTISSA / 3
    return np.maximum(same - chance, 0) / np.maximum(used - chance, 1e-9)


def _near_in_size(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def least_estimate(params: Params, sigmas: float = 5.0) -> float:
    """An estimate below this is not from a similar enough pair."""
    share = params.percent / 100
    return share - sigmas * float(np.sqrt(share * (1 - share) / BUCKETS))


def confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """The pairs (a, b) of rows whose estimate is not clearly too low and whose full sets are similar enough."""
    floor = least_estimate(params)
    regs = sketches.select("row", "registers")
    both = pairs.join(regs.select(F.col("row").alias("a"), F.col("registers").alias("ra")), "a")
    both = both.join(regs.select(F.col("row").alias("b"), F.col("registers").alias("rb")), "b").select("a", "b", "ra", "rb")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BUCKETS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(estimate(a, b) >= floor))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = sets_of(pa.concat_arrays([part.column(2), part.column(3)]), params.shingle).exact()
                near = [similar_sets(sets[i], sets[part.num_rows + i], params.percent) for i in range(part.num_rows)]
                yield part.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = save(both.mapInArrow(likely, "a long, b long"), "likely")
    # Only texts that a pair needs are moved.
    needed = both.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = texts.select("row", F.col("text").alias("t")).join(needed, "row", "left_semi")
    whole = both.join(texts.select(F.col("row").alias("a"), F.col("t").alias("ta")), "a")
    whole = whole.join(texts.select(F.col("row").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")
    return whole.mapInArrow(similar, "a long, b long")


def likely_rows(regs: np.ndarray, sizes: np.ndarray, owner: np.ndarray, i: int, js: np.ndarray, params: Params) -> np.ndarray:
    """Of js, those of another owner, of similar size and of an estimate that may be enough, best first."""
    n = sizes[js]
    js = js[(owner[js] != owner[i]) & (n * 100 >= sizes[i] * params.percent) & (sizes[i] * 100 >= n * params.percent)]
    if not len(js):
        return js
    own, others = regs[i], regs[js]
    used = own > 0
    same = ((others == own) & used).sum(1)
    wide = used.sum() + (others[:, ~used] > 0).sum(1)
    chance = wide * 2.0**-MANTISSA / 3
    likeness = (same - chance) / np.maximum(wide - chance, 1e-9)
    return js[np.argsort(-likeness, kind="stable")[: int((likeness >= least_estimate(params)).sum())]]


def later_rows(side: np.ndarray, i: int) -> np.ndarray:
    """Partners of row i: the rows of the other block, or the later rows where all are of one."""
    js = np.arange(i + 1, len(side))
    return js if side[0] == side[-1] else js[side[js] != side[i]]


def links_across(sets: Sets, owner: np.ndarray, side: np.ndarray, params: Params) -> list[tuple[int, int]]:
    """Places of pairs of similar sets of different owners, as few as join the same owners."""
    sizes, exact = np.diff(sets.at), sets.exact()
    regs = registers(sets.hashes[0], sets.at)
    root, out = {c: c for c in owner.tolist()}, []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for i in range(len(sizes)):
        for j in likely_rows(regs, sizes, owner, i, later_rows(side, i), params).tolist():
            x, y = find(int(owner[i])), find(int(owner[j]))
            if x != y and similar_sets(exact[i], exact[j], params.percent):
                root[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def dealt(rows: DataFrame, group: str, params: Params) -> tuple[DataFrame, int]:
    """rows of (group, row, c, n_shingles) over tasks (group, i, j), and how many rows were dealt from.

    The largest component of a group has nothing to find in itself. The other members, cut
    into blocks, meet its blocks and one another's: (i, j) with j from 0 on is block i
    of the others and block j of the largest, (i, -1 - j) are two blocks of the others.
    side tells the two apart. A group of one block each stays together. So a million copies and one other text cost a row for each
    copy and one for each block. Groups of one component go.
    """
    parts = rows.groupBy(group, "c").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    whole = parts.groupBy(group).agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.max(F.struct("n", "c")).alias("top"), F.max_by("w", F.struct("n", "c")).alias("top_w"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("parts"))
    whole = whole.where("parts > 1")

    def blocks(n: Column, w: Column) -> Column:
        return F.ceil(F.greatest(n / params.block, w / params.shingles)).cast("int")

    whole = save(whole.select(group, "n", "most", blocks(F.col("top.n"), F.col("top_w")).alias("large"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top_w")).alias("small")), "blocks")
    total = whole.agg(F.sum("n")).first()[0] or 0
    rows = rows.join(whole.drop("n"), group)
    mixed = F.xxhash64("row")
    main = F.col("c") == F.col("most")
    own = F.pmod(mixed, F.when(main, F.col("large")).otherwise(F.col("small"))).cast("int")
    rows = rows.withColumn("main", main).withColumn("own", own)
    small, large = (F.sequence(F.lit(0), F.col(k) - 1) for k in ("small", "large"))

    def task(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), side.alias("side"))

    to_main = F.transform(large, lambda k: task(F.col("own"), k, F.lit(0)))
    to_others = F.transform(small, lambda k: task(F.least(F.col("own"), k), -1 - F.greatest(F.col("own"), k), F.col("own")))
    places = F.when(F.col("main"), F.transform(small, lambda k: task(k, F.col("own"), F.lit(1)))).otherwise(F.concat(to_main, to_others))
    together = (F.col("small") == 1) & (F.col("large") == 1)
    places = F.when(together, F.array(task(F.lit(0), F.lit(0), F.lit(0)))).otherwise(places)
    rows = rows.withColumn("place", F.explode(places))
    return rows.select(*[c for c in rows.columns if c not in ("place", "main", "own", "most")], "place.i", "place.j", "place.side"), total


def meeting(members: DataFrame, sketches: DataFrame, params: Params) -> DataFrame:
    """(hub, row, c, n_shingles): texts of (bucket, row, c, hub) that registers find likely similar to a text of that hub.

    Small buckets share tasks of about params.block rows; large ones are dealt over blocks.
    """
    spark = members.sparkSession
    rows, total = dealt(members, "bucket", params)
    tasks = max(16 * shuffle_partitions(spark), -(-total // params.block))
    rows = rows.join(sketches.select("row", "registers"), "row")
    alone = (F.col("small") > 1) | (F.col("large") > 1)
    rows = rows.withColumn("task", F.when(alone, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(tasks))))

    def meet(table: pa.Table) -> pa.Table:
        names = ("row", "c", "hub", "bucket", "side", "n_shingles")
        ids, owner, hub, bucket, side, sizes = (table.column(c).to_numpy() for c in names)
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(-1, BUCKETS)
        order = np.lexsort((ids, side, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        found = set()
        for part in np.split(order, cuts):
            r, n, c, s, h = regs[part], sizes[part], owner[part], side[part], hub[part]
            if c.min() == c.max():
                continue
            for i in range(len(part)):
                js = likely_rows(r, n, c, i, later_rows(s, i), params)
                if len(js):
                    found.update((x, int(ids[part[i]]), int(c[i]), int(n[i])) for x in set(h[js].tolist()) | {int(h[i])})
                    found.update((x, int(ids[part[j]]), int(c[j]), int(n[j])) for j in js.tolist() for x in (int(h[i]), int(h[j])))
        rows = list(found)
        return pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("hub", "row", "c", "n_shingles"))})

    met = rows.select("task", "i", "j", "bucket", "side", "row", "c", "hub", "n_shingles", "registers").groupBy("task", "i", "j").applyInArrow(meet, "hub long, row long, c long, n_shingles long")
    return met.distinct()


def searched(mixed: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Links (a, b) between components inside groups of (hub, row, c, n_shingles).

    A group is dealt over blocks; where two blocks meet, a task compares registers, then
    full sets, and returns as few links as join the same components.
    """
    rows, _ = dealt(mixed, "hub", params)
    needed = rows.select("row").distinct()
    texts = texts.select("row", F.col("text").alias("t")).join(needed, "row", "left_semi")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("row", "ascending")])
        ids = table.column("row").to_pylist()
        found = links_across(sets_of(table.column("t"), params.shingle), table.column("c").to_numpy(), table.column("side").to_numpy(), params)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return rows.join(texts, "row").select("hub", "i", "j", "side", "row", "c", "t").groupBy("hub", "i", "j").applyInArrow(search, "a long, b long")


def _grouped(rows: DataFrame, params: Params) -> DataFrame:
    """row, id, n_shingles, component_id and first of a saved table (row, id, text)."""
    sketches = save(sketch(rows, params), "sketches")
    filled = sketches.where("n_shingles > 0")
    same = ["set1", "set2", "n_shingles"]
    # The least id of the rows of a set, nulls last, with its row.
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = save(filled.groupBy(*same).agg(F.min("row").alias("node"), F.min(least).alias("least")), "nodes")
    ours = filled.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    width = 2 * params.band
    empty = F.lit(bytes(width))

    def band(i: Column) -> Column:
        part = F.substring(F.col("registers"), i * width + 1, F.lit(width))
        return F.when(part != empty, F.xxhash64(i, part))

    buckets = F.explode(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), band)))
    banded = ours.select("row", "n_shingles", buckets.alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = save(banded.join(sizes, "bucket"), "buckets")
    # A text that its copies were made from shares more buckets with them than they do with each other.
    met = shared.groupBy("row").agg(F.sum("members").alias("met"))
    shared = shared.join(met, "row")
    rank = F.struct("met", -F.col("row"))
    heads = shared.groupBy("bucket").agg(F.max_by("row", rank).alias("head"), F.max_by("n_shingles", rank).alias("head_n"), F.max("met").alias("head_met"))
    shared = save(shared.join(heads, "bucket"), "buckets")
    first = shared.where("row <> head").where(_near_in_size(F.col("n_shingles"), F.col("head_n"), params.percent))
    first = first.select(F.col("head").alias("a"), F.col("row").alias("b")).distinct()
    links = save(confirmed(first, sketches, rows, params), "links")
    found = components(links)

    wide = shared.join(found.withColumnRenamed("node", "row"), "row", "left")
    hubs = wide.groupBy("row").agg(F.max_by("head", F.struct("head_met", -F.col("head"))).alias("hub"))
    # A bucket of two has been compared already.
    wide = wide.where("members > 2").select("bucket", "row", "n_shingles", F.coalesce("component", "row").alias("c"))
    wide = save(wide.join(hubs, "row"), "wide")
    groups = save(meeting(wide, sketches, params), "groups")
    more = save(searched(groups, rows, params), "links")
    found = save(components(links.unionByName(more)), "components")

    nodes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = nodes.groupBy("component").agg(F.min("least").alias("lowest"))
    nodes = nodes.join(lowest, "component").select(*same, "lowest")
    out = sketches.select("row", "id", *same).join(nodes, same, "left")
    component = F.when(F.col("lowest").isNull(), F.col("id")).otherwise(F.col("lowest.id"))
    return out.select("row", "id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("lowest.row") == F.col("row"), F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept and first of every row.

    Words are lower-cased in A-Z. Texts with equal sets are one node; nodes are linked if
    their sets' similarity is at least params.percent hundredths; component_id is the
    smallest key reachable, kept marks the rows that have it, first one row of each
    component. Null texts and texts without words have no shingles and no links. Rows that
    repeat a key stay, each with its own text. A null key is larger than all others and
    kept where its component has no other. An empty table gives an empty table; other
    columns are ignored.

    1. Rows with equal sets collapse to one, with partial aggregation, so a group of
       copies of any size costs a row for each task.
    2. Bands of registers give buckets. Every member is compared with its bucket's head,
       the text that shares most buckets: a group of copies of one text is mostly joined
       by as many pairs as it has members.
    3. In buckets that still hold several components, tasks compare registers across them,
       block by block, and note which texts may be similar to texts of which other head.
       Those groups are then compared on full sets, again block by block, and give as few
       links as join components. A pair inside a component can add nothing and is skipped.

    A link is confirmed on the words of both texts. Equal sets are told by their number of
    shingles and two sums of independent 64-bit hashes.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    out = _grouped(save(rows, "rows"), params)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", kept.alias("kept"), "first")


def deduplicated(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest key (nulls last), whatever its columns are called.

    Rows without a key, and rows that repeat a key, are judged by their texts alone. Texts
    without words all stay.
    """
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(docs.columns)]
    rows = save(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")
    named = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    found = _grouped(rows.select("row", F.col(named[key]).cast("long").alias("id"), F.col(named[text]).alias("text")), params)
    kept = rows.join(found.where("first").select("row"), "row", "left_semi")
    return kept.select(*[F.col(k).alias(c) for c, k in named.items()])
