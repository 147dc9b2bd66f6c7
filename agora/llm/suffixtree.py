"""Scores by a probabilistic suffix tree over word symbols, on counts of all words of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import save, whole_texts
from agora.llm.textarrays import FOLDED, Chunk, chunks, hashes_of, mix, word_numbers

#: Symbols of the end of a text and of what stands before it begins; frequent words follow, then endings.
END, START = 0, 1


@dataclass(frozen=True)
class Params:
    """What bounds a model, whatever the corpus.

    words: frequent words that are symbols of their own; endings: symbols for all other
    words, by their last two bytes. depth: symbols in the longest context. share: a
    context holds at least 1 / share of all places, so each depth has at most `share`
    contexts. known: words whose counts every task holds; the rest are joined.
    """

    words: int = 766
    endings: int = 256
    depth: int = 3
    share: int = 4096
    known: int = 1 << 19

    @property
    def symbols(self) -> int:
        return 2 + self.words + self.endings


def _tokens(chunk: Chunk, endings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: the kind of each token, each text's first (n + 1), and hashes (2 x kinds) and ending of the kinds.

    A text's tokens are its words, lower-cased in A-Z, then one end, which is spelled as no
    bytes and has ending -1.
    """
    data = FOLDED[chunk.data]
    starts, ends, first = Chunk(0, data, chunk.offsets).words()
    number, spelled = word_numbers(data, starts, ends)
    kinds = len(spelled)
    hashes = np.hstack([hashes_of(spelled), hashes_of(pa.array([b""]))])
    last = np.zeros(kinds, np.int64)
    last[number] = ends - 1
    before = np.zeros(kinds, np.int64)
    before[number] = np.maximum(starts, ends - 2)
    pair = data[before].astype(np.uint64) << np.uint64(8) | data[last].astype(np.uint64)
    ending = np.append((mix(pair + np.uint64(1)) % np.uint64(endings)).astype(np.int64), -1)
    return np.insert(number, first[1:], kinds), first + np.arange(chunk.n + 1), hashes, ending


def word_counts(docs: DataFrame, params: Params = Params(), text: str = "text") -> DataFrame:
    """(h1, h2, ending, c): occurrences of each word and of the end in docs; 128 bits of hash tell words apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0), 4 << 20):
                kind, _, hashes, ending = _tokens(chunk, params.endings)
                count = np.bincount(kind, minlength=len(ending))
                h = hashes.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(ending.astype(np.int32)), pa.array(count)], ["h1", "h2", "ending", "c"])

    return whole_texts(docs).select(F.col(text)).mapInArrow(run, "h1 long, h2 long, ending int, c long").where("c > 0").groupBy("h1", "h2", "ending").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Of the most frequent words: first hash halves in order, counts, symbols; of all: tokens, words, and both by ending."""

    params: Params
    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    tokens: int
    words: int
    of_ending: np.ndarray  # (tokens, words) of each ending, without words that are symbols

    @property
    def base(self) -> float:
        """What log10(c + 1) loses in an add-one distribution over all words and one unknown."""
        return float(np.log10(self.tokens + self.words + 1))

    def of(self, hashes: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count (-1: not among the most frequent) and symbol of each kind."""
        place = np.minimum(np.searchsorted(self.hashes, hashes[0]), max(len(self.hashes) - 1, 0))
        found = self.hashes[place] == hashes[0] if len(self.hashes) else np.zeros(len(ending), bool)
        count = np.where(found, self.counts[place] if len(self.hashes) else 0, -1)
        symbol = np.where(found, self.symbols[place] if len(self.hashes) else -1, -1)
        symbol = np.where(symbol < 0, 2 + self.params.words + ending, symbol)
        return count, np.where(ending < 0, END, symbol)


def vocabulary(words: DataFrame, params: Params = Params()) -> Vocabulary:
    """The vocabulary of a saved table of word_counts(); the driver gets at most params.known rows."""
    bucket = F.floor(F.log2("c") * 8)
    sizes = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("b")).collect()
    least, held = None, 0
    for row in sizes:  # a row for each eighth of a power of two
        if held + row.n > params.known:
            break
        least, held = row.b, held + row.n
    top = words.where(bucket >= least if least is not None else F.lit(False)).toArrow()
    h1, h2, ending, c = (top.column(k).to_numpy() for k in ("h1", "h2", "ending", "c"))
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    order = np.lexsort((h2, h1, -c))
    order = order[ending[order] >= 0][: params.words]
    symbols = np.full(len(c), -1, np.int64)
    symbols[order] = 2 + np.arange(len(order))
    rest = np.zeros((params.endings, 2), np.int64)
    for row in words.where("ending >= 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        rest[row.ending] = row.c, row.n
    np.subtract.at(rest, ending[order], np.column_stack([c[order], np.ones(len(order), np.int64)]))
    sort = np.argsort(h1)
    return Vocabulary(params, h1[sort], c[sort], symbols[sort], sum(r.c for r in sizes), sum(r.n for r in sizes), rest)


def encode(docs: DataFrame, learn: Column, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every document: row, id, learn, n_tokens, n_known, logs, ending_logs, symbols and rare.

    Of the tokens that the vocabulary holds: n_known, the sum of log10(c + 1), and the part
    of it from tokens whose symbol is an ending. rare has 16 bytes of hash for every other
    token; symbols has 2 bytes for every token.
    """
    schema = "row long, id long, learn boolean, n_tokens long, n_known long, logs double, ending_logs double, symbols binary, rare binary"
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(3), 4 << 20):
                kind, at, hashes, ending = _tokens(chunk, vocab.params.endings)
                count, symbol = vocab.of(hashes, ending)
                log = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                by_ending = symbol >= 2 + vocab.params.words
                sums = [np.add.reduceat(x[kind], at[:-1]) for x in ((count > 0).astype(np.int64), log, log * by_ending)]
                coded = symbol.astype("<u2")[kind].tobytes()
                missing = count[kind] < 0
                lost = np.append(0, np.cumsum(missing))[at] * 16
                rare = np.ascontiguousarray(hashes.T)[kind[missing]].tobytes()
                cut = [coded[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                left = [rare[a:b] for a, b in zip(lost[:-1].tolist(), lost[1:].tolist(), strict=True)]
                own = [batch.column(i).slice(chunk.first, chunk.n) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), *map(pa.array, sums), pa.array(cut, pa.binary()), pa.array(left, pa.binary())], [x.split()[0] for x in schema.split(", ")])

    rows = whole_texts(docs).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text))
    return rows.mapInArrow(run, schema)


@dataclass
class Tree:
    """States in order of their depth, the empty context first.

    find[d] holds, in order, (state of depth d) * symbols + (symbol before it) for the states
    of depth d + 1, and to[d] these states. log10 has a row of probabilities for each state.
    """

    find: list[np.ndarray] = field(default_factory=list)
    to: list[np.ndarray] = field(default_factory=list)
    log10: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))

    def states(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The state of the longest kept suffix of what stands before each symbol."""
        return _contexts(symbols, at, self.log10.shape[1], self.find, self.to)[0]


def _contexts(symbols: np.ndarray, at: np.ndarray, width: int, find: list[np.ndarray], to: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the deepest context of a tree, and whether it has len(find) symbols.

    A text begins with START before its first symbol and nothing before that.
    """
    n = len(symbols)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    state, open_ = np.zeros(n, np.int64), np.arange(n)
    for d, (keys, values) in enumerate(zip(find, to, strict=True)):
        open_ = open_[place[open_] >= d]  # START counts as the symbol before the first
        if not len(keys):
            open_ = open_[:0]
        if not len(open_):
            break
        before = np.where(place[open_] == d, START, symbols[np.maximum(open_ - d - 1, 0)])
        key = state[open_] * width + before
        spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[spot] == key
        open_ = open_[hit]
        state[open_] = values[spot[hit]]
    deep = np.zeros(n, bool)
    deep[open_] = True
    return state, deep


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some rows joined, and where each row's begin."""
    rows = column.to_pylist()
    at = np.append(0, np.cumsum([len(r) // 2 for r in rows], dtype=np.int64))
    return np.frombuffer(b"".join(rows), "<u2").astype(np.int64), at


def _followers(coded: DataFrame, width: int, find: list[np.ndarray], to: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each context of depth len(find): the symbols that follow it in the learned rows, and their counts.

    A task counts what it reads in one array of contexts x symbols; the driver gets as
    many rows at most.
    """
    size = (len(to[-1]) if to else 1) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            symbols, at = _symbols(batch.column(0))
            state, deep = _contexts(symbols, at, width, find, to)
            count += np.bincount(state[deep] * width + symbols[deep], minlength=size)
        key = np.flatnonzero(count)
        for a in range(0, len(key), 1 << 16):
            part = key[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[part])], ["key", "n"])

    found = coded.where("learn").select("symbols").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    key, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    state = key // width
    cuts = np.flatnonzero(np.diff(state)) + 1
    return {int(s[0]): (k % width, c) for s, k, c in zip(np.split(state, cuts), np.split(key, cuts), np.split(n, cuts), strict=True) if len(s)}


def fit(coded: DataFrame, params: Params = Params()) -> Tree:
    """The tree of the learned rows of a saved table of encode().

    Contexts of a depth are counted together: those that hold at least 1 / params.share of
    all places, which those of the depth above tell. A context is kept where the divergence
    of its next symbols from those of the longest kept suffix, times its places, exceeds
    half the logarithm of its places for each symbol that follows: where its own
    distribution saves more than it costs to say. A state's distribution is
    (count + t x suffix's) / (places + t), t being the number of symbols that follow; the
    empty context's is add-one over all symbols.
    """
    width, none = params.symbols, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    after = _followers(coded, width, [], [])
    seen, count = after.get(0, none)
    total = int(count.sum())
    first = np.ones(width)
    first[START] = 0  # never follows
    np.add.at(first, seen, count)
    table = [first / first.sum()]
    kept: dict[tuple[int, ...], int] = {(): 0}  # contexts, the last symbol first
    level = {(): 0}
    find: list[np.ndarray] = []
    to: list[np.ndarray] = []
    for depth in range(1, params.depth + 1):
        # What follows a context n times makes, in front of it, a context of n places.
        wanted = [((symbol, *context), n) for context, s in level.items() for symbol, n in zip(*(x.tolist() for x in after.get(s, none)), strict=True)]
        if depth == 1:
            wanted = [((START,) if c == (END,) else c, n) for c, n in wanted]  # as many texts begin as end
        pairs = sorted((level[c[:-1]] * width + c[-1], c) for c, n in wanted if n * params.share >= total and END not in c and c[:-1] in level)
        if not pairs:
            break
        find, to = [*find, np.array([p for p, _ in pairs])], [*to, np.arange(len(pairs))]
        level = {c: i for i, (_, c) in enumerate(pairs)}
        after = _followers(coded, width, find, to)
        for context, s in level.items():
            seen, count = after.get(s, none)
            n = int(count.sum())
            under = table[next(kept[context[:k]] for k in range(depth - 1, -1, -1) if context[:k] in kept)]
            if n and float((count * np.log(count / n / under[seen])).sum()) > len(seen) * np.log(n) / 2:
                own = under * len(seen)
                np.add.at(own, seen, count)
                kept[context] = len(table)
                table.append(own / own.sum())
    return _tree(kept, table, width)


def _tree(kept: dict[tuple[int, ...], int], table: list[np.ndarray], width: int) -> Tree:
    """Contexts whose suffixes are not kept themselves get them as states with the distribution they inherit."""
    for context in sorted(kept, key=len):
        for k in range(1, len(context)):
            if context[:k] not in kept:
                kept[context[:k]] = len(table)
                table.append(table[kept[context[: k - 1]]])
    find, to = [], []
    for d in range(max(map(len, kept))):
        pairs = sorted((kept[c[:-1]] * width + c[-1], s) for c, s in kept.items() if len(c) == d + 1)
        find.append(np.array([p for p, _ in pairs], np.int64))
        to.append(np.array([s for _, s in pairs], np.int64))
    with np.errstate(divide="ignore"):
        return Tree(find, to, np.log10(np.stack(table)).astype(np.float32))


def score(docs: DataFrame, learn: Column, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, learned, n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    Tokens are words, lower-cased in A-Z, and one end. base_score sums log10 of the add-one
    probability of each token among those of the rows where `learn` holds. score is the
    log10 probability of the text by a suffix tree over symbols: frequent words have one
    each, other words one by their last two bytes. A symbol's probability comes from the
    state of the longest kept suffix of the symbols before it; a word's among those of its
    ending is add-one too, with one share for all unknown words, so both are proper
    distributions over the same tokens.

    Counts of the most frequent words and the tree are broadcast; Params bounds both. Counts
    of all other words are joined to the texts that have them, one row for each text and
    word. Null and empty texts are one end. A null `learn` counts as false. Rows that
    repeat a key are scored each by its own text; where no row is learned from, all tokens
    are unknown and symbols equally likely; an empty table gives an empty table; other
    columns are ignored.
    """
    words = save(word_counts(docs.where(F.coalesce(learn, F.lit(False))), params, text), "words")
    vocab = vocabulary(words, params)
    coded = save(encode(docs, learn, vocab, key, text), "coded")
    tree = fit(coded, params)
    return scored(coded, words, vocab, tree).withColumnRenamed("id", key)


def rare_words(coded: DataFrame) -> DataFrame:
    """(row, h1, h2, n): the words of each text that the vocabulary does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            flat = np.frombuffer(b"".join(rows), np.int64).reshape(-1, 2)
            if len(flat):
                own = np.repeat(np.arange(len(rows)), [len(r) // 16 for r in rows])
                order = np.lexsort((flat[:, 1], flat[:, 0], own))
                flat, own = flat[order], own[order]
                new = np.append(True, (np.diff(own) != 0) | (np.diff(flat, axis=0) != 0).any(1))
                first = np.flatnonzero(new)
                row = batch.column(0).to_numpy()[own[first]]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(flat[first, 0]), pa.array(flat[first, 1]), pa.array(np.diff(np.append(first, len(flat))))], ["row", "h1", "h2", "n"])

    return coded.where("length(rare) > 0").select("row", "rare").mapInArrow(run, "row long, h1 long, h2 long, n long")


def scored(coded: DataFrame, words: DataFrame, vocab: Vocabulary, tree: Tree) -> DataFrame:
    """id, learned, n_tokens, n_known, train_tokens, base_score and score of a saved table of encode()."""
    rare = rare_words(coded).join(words.select("h1", "h2", "c"), ["h1", "h2"])
    rare = rare.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.log10(F.col("c") + 1) * F.col("n")).alias("more_logs"))
    shared = coded.sparkSession.sparkContext.broadcast(tree)
    # What a token of each symbol loses among the words of its ending.
    share = np.zeros(vocab.params.symbols)
    share[2 + vocab.params.words :] = np.log10(vocab.of_ending.sum(1) + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            symbols, at = _symbols(batch.column(batch.num_columns - 1))
            each = tree.log10[tree.states(symbols, at), symbols] - share[symbols]
            sums = np.add.reduceat(each, at[:-1]) if len(each) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], [*batch.schema.names[:-1], "symbol_logs"])

    columns = ["row", "id", "learn", "n_tokens", "n_known", "logs", "ending_logs"]
    rows = coded.select(*columns, "symbols").mapInArrow(run, "row long, id long, learn boolean, n_tokens long, n_known long, logs double, ending_logs double, symbol_logs double")
    rows = rows.join(rare, "row", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    return rows.select(
        "id",
        F.col("learn").alias("learned"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * vocab.base).alias("base_score"),
        (F.col("symbol_logs") + F.col("ending_logs") + more).alias("score"),
    )
