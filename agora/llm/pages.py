"""Main text of web pages: what is no text by its element goes, and what style trees show as noise.

The pages of a host are merged into a style tree. Its nodes are elements by their path of
tags and names; a node's importance comes from the entropy of what it shows over the
pages. Names that claim to be adverts or notices are merged over all hosts into a tree of
their own, as most hosts have too few pages to judge them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import save, shuffle_partitions, whole_texts
from agora.llm.urls import host_and_path

# Fixed values of HTML: how elements nest and which of them start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}

# Elements, roles and names of class or id of what an article is without by definition.
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input dialog object embed applet canvas audio video menu title map datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
PARTS = frozenset("menu nav navbar subnav navigation breadcrumb breadcrumbs sidebar sidenav footer comment comments commentlist disqus replies respond form login search pagination pager toolbar masthead".split())
#: Names that adverts and notices bear; a style tree over all hosts says whether they are what they claim.
CLAIMS = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recirculation widget".split())
#: Words that say where something stands, not what it is.
LAYOUT = frozenset("slot box container wrapper wrap area section list bar block top bottom left right unit inner outer item link links panel holder group row col column primary secondary header heading title site page global post".split())
#: Words of the comments of readers, and those that may stand beside them; they name an article element too.
COMMENTS, OF_READERS = frozenset("comment comments commentlist reply replies respond".split()), frozenset("reader readers user users guest article thread body author text even odd depth child parent".split())
#: Elements whose names are about their own text.
UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 article main body html".split())
DEEPEST = 48  # levels of a page that have style nodes
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"v?\d+")  # of a version or an item, which names nothing


@dataclass
class Element:
    """What an open tag says: furniture by itself, a claim (one of CLAIMS) or none, its signature in the style tree."""

    furniture: bool
    claim: str
    signature: str


def element(tag: str, attributes: str, in_article: bool) -> Element:
    """Class and id name an element only where all of their words do, so `form factor` is no form."""
    words: set[str] = set()
    furniture = tag in FURNITURE or (tag == "header" and not in_article)
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words.update(w for w in _SPLIT.split(value.lower()) if w and not _NUMBER.fullmatch(w))
        elif name == "role":
            furniture |= value.lower().strip() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSHOWN.search(value):
            furniture = True
    claim = ""
    furniture |= bool(words & COMMENTS) and words <= COMMENTS | OF_READERS | LAYOUT
    if words and tag not in UNNAMED and words <= PARTS | CLAIMS | LAYOUT:
        furniture |= bool(words & PARTS) or ("header" in words and not in_article)
        claim = min(words & CLAIMS, default="")
    kept = sorted(w for w in words if not any(ch.isdigit() for ch in w))
    return Element(furniture, claim, f"{tag}.{'.'.join(kept)}")


@dataclass
class Block:
    text: str
    chain: tuple[int, ...]  # style nodes from the root to the block
    article: bool  # inside article or main
    furniture: bool
    claims: tuple[str, ...]


def blocks(page: str) -> list[Block]:
    """All blocks of text of a page in page order, furniture too; scripts and the like have none."""
    out: list[Block] = []
    # Open elements: tag, element, style node.
    stack: list[tuple[str, Element, int]] = []
    open_tags: Counter[str] = Counter()
    chain: list[int] = []  # style nodes of the open block elements, the first DEEPEST
    parts: list[tuple[bool, tuple[str, ...], str]] = []
    claims: list[str] = []
    furniture = articles = blocks_open = at = 0
    n = len(page)

    def say(text: str) -> None:
        # A reference ends with its piece of text: tags do not join its parts.
        parts.append((furniture > 0, tuple(claims), html.unescape(text) if "&" in text else text))

    def flush() -> None:
        # What an inline element hides or claims is a block of its own; the text around it stays one.
        while parts:
            hidden, claimed, _ = parts[0]
            text = _SPACE.sub(" ", "".join(p[2] for p in parts if p[:2] == (hidden, claimed))).strip()
            parts[:] = [p for p in parts if p[:2] != (hidden, claimed)]
            if text:
                out.append(Block(text, tuple(chain), articles > 0, hidden, claimed))

    def pop_to(k: int) -> None:
        nonlocal furniture, articles, blocks_open
        while len(stack) > k:
            tag, what, _ = stack.pop()
            open_tags[tag] -= 1
            furniture -= what.furniture
            articles -= tag in ("article", "main")
            if what.claim:
                claims.pop()
            if tag not in INLINE:
                blocks_open -= 1
                if blocks_open < DEEPEST:
                    chain.pop()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:  # a comment or a declaration
            continue
        tag = tag.lower()
        if m[1]:
            if not open_tags[tag]:
                if tag not in INLINE:
                    flush()
                continue
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
            if tag not in INLINE:
                flush()
            pop_to(k)
            continue
        if tag == "br":
            say(" ")
            continue
        block = tag not in INLINE and tag not in VOID
        if block or tag == "hr":
            flush()
        if block:
            # A new block ends an open paragraph, and entries end entries before them.
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p":
                    pop_to(i)
                    break
                if name not in INLINE:
                    break
            if tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in LIMITS[tag]:
                        break
                    if stack[i][0] in CLOSES[tag]:
                        pop_to(i)
                        break
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in INLINE and tag not in ("p", "div", "article", "section", "main", "body"):
            continue
        what = element(tag, m[3], articles > 0)
        above = stack[-1][2] if stack else 0
        node = xxhash.xxh64_intdigest(what.signature, above) if block else above
        stack.append((tag, what, node))
        open_tags[tag] += 1
        furniture += what.furniture
        articles += tag in ("article", "main")
        if what.claim:
            claims.append(what.claim)
        if block:
            if blocks_open < DEEPEST:
                chain.append(node)
            blocks_open += 1
    flush()
    return out


def main_blocks(found: list[Block], noise: set[int] = frozenset(), acquitted: frozenset[str] = frozenset()) -> list[Block]:
    """Blocks that are no furniture, claim only what is acquitted and have no noise above them.

    Of a page with article or main, those inside. Where the style tree would leave
    nothing, it is not applied.
    """
    found = [b for b in found if not b.furniture and acquitted.issuperset(b.claims)]
    kept = [b for b in found if noise.isdisjoint(b.chain)] or found
    return [b for b in kept if b.article] or [b for b in found if b.article] or kept


@dataclass(frozen=True)
class Params:
    """A style node of at least `pages` pages with an importance below `least` is noise.

    A claim is acquitted where `claim_pages` pages over all hosts show it with an importance
    of `sure` or more: what hardly ever repeats is no advert and no notice. With `tree` off
    nothing is noise and every claim is acquitted. `broadcast` bounds the noise nodes that
    are broadcast; beyond it pages and nodes are shuffled by host and a salt.
    """

    pages: int = 8
    least: float = 0.3
    claim_pages: int = 200
    sure: float = 0.95
    decay: float = 0.9
    tree: bool = True
    broadcast: int = 20_000
    salts: int = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _claim_node(name: str) -> int:
    return xxhash.xxh64_intdigest(name, 1)


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, n): on how many pages a node has a content or a presentation.

    Kind 0 counts pages with the node, 1 each text below it, 2 each sequence of blocks
    below it. The tree of the claims of all pages has no host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[tuple[str, int, int, int]] = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                below: dict[tuple[str, int], list[tuple[int, int]]] = {}
                for block in blocks(page or ""):
                    shown = xxhash.xxh64_intdigest(block.text), block.chain[-1] if block.chain else 0
                    for node in dict.fromkeys(block.chain) if host else ():
                        below.setdefault((host, node), []).append(shown)
                    for name in dict.fromkeys(block.claims):
                        below.setdefault(("", _claim_node(name)), []).append(shown)
                for (tree, node), found in below.items():
                    total[tree, node, 0, 0] += 1
                    for content in {c for c, _ in found}:
                        total[tree, node, 1, content] += 1
                    total[tree, node, 2, xxhash.xxh64_intdigest(repr(list(dict.fromkeys(k for _, k in found))))] += 1
            keys = list(total)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), pa.array([_signed(k[3]) for k in keys], pa.int64()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "node", "kind", "feature", "n"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, node long, kind int, feature long, n long")
    return rows.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))


def importance(nodes: DataFrame, params: Params = Params()) -> DataFrame:
    """(host, node, m, importance) of the nodes of at least params.pages pages.

    With m pages, a text on k of them has entropy log k / log m, and content importance is
    1 less the mean entropy of the node's texts. Presentation importance is the entropy of
    the node's block sequences over pages. The more kinds of sequences a node has, the
    more its presentation counts.
    """
    k = F.col("n").cast("double")
    content, shown = F.col("kind") == 1, F.col("kind") == 2
    node = nodes.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.avg(F.when(content, F.log(k))).alias("content"),
        F.sum(F.when(shown, k * F.log(k))).alias("shown"),
        F.sum(F.when(shown, k)).alias("pages"),
        F.count(F.when(shown, 1)).alias("kinds"),
    )
    node = node.where(F.col("m") >= params.pages)
    log_m = F.log(F.col("m").cast("double"))
    content_importance = 1 - F.col("content") / log_m
    shown_importance = (F.log(F.col("pages").cast("double")) - F.col("shown") / F.col("pages")) / log_m
    weight = F.pow(F.lit(params.decay), F.col("kinds").cast("double"))
    # A claim's element stands alone in its tree, so that only its content tells.
    weight = F.when(F.col("host") == "", 1.0).otherwise(weight)
    return node.select("host", "node", "m", ((1 - weight) * shown_importance + weight * content_importance).alias("importance"))


def extract(pages: DataFrame, params: Params = Params(), key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row: the page's main text.

    Blocks are trimmed, white space inside is one blank, character references are decoded,
    and blocks are joined by an empty line. The style trees are built over whole pages and
    name noise first; then the article is taken, less what is furniture by definition.
    Where the style tree would leave nothing of a page, it is not applied to it. Null and
    empty pages have an empty text; pages without a host have no style tree of their own;
    repeated rows stay, equal pages of a host get equal texts; an empty table gives an
    empty table; other columns are ignored.
    """
    host, _ = host_and_path(F.col(url))
    rows = whole_texts(pages).select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), F.col(source).alias("html"))
    acquitted = frozenset(CLAIMS)
    if params.tree:
        judged = importance(style_nodes(rows), params)
        odd = (F.col("host") != "") & (F.col("importance") < params.least)
        sure = (F.col("host") == "") & (F.col("importance") >= params.sure) & (F.col("m") >= params.claim_pages)
        found = save(judged.where(odd | sure).select("host", "node"), "noise")
        # At most as many as there are CLAIMS.
        named = {r["node"] for r in found.where("host = ''").collect()}
        acquitted = frozenset(c for c in CLAIMS if _signed(_claim_node(c)) in named)
        rows = _with_noise(rows, found.where("host <> ''"), params)
    else:
        rows = rows.withColumn("noise", F.lit(None).cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, bad in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                noise = {x % (1 << 64) for x in bad or ()}
                texts.append("\n\n".join(b.text for b in main_blocks(blocks(page or ""), noise, acquitted)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["k", "u", "text"])

    kinds = dict(rows.dtypes)
    out = rows.select("k", "u", "html", "noise").mapInArrow(run, f"k {kinds['k']}, u string, text string")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def _with_noise(rows: DataFrame, found: DataFrame, params: Params) -> DataFrame:
    """rows with the list of noise nodes of their host."""
    lists = found.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("noise"))
    if found.count() <= params.broadcast:
        return rows.join(F.broadcast(lists), "host", "left")
    salts = min(params.salts, shuffle_partitions(rows.sparkSession))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("u", "k"), F.lit(salts)).cast("int")).join(lists, ["host", "salt"], "left")
