import collections
import math

from pyspark.sql import functions as F

from agora.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><h1>Head &amp; line</h1><p><b>One  two<br>three<p>Four &lt;five&gt; <i>six</i></p><form>Name</form><aside>Side</aside>
<ul><li>a<li>b</ul><p hidden>gone</p><div class="comments"><p>First!</p></div></article><footer>&copy; me</footer>"""


def text(page, **how):
    return "\n\n".join(b.text for b in pages.main_blocks(pages.blocks(page), **how))


def test_one_page():
    assert text(PAGE) == "Head & line\n\nOne two three\n\nFour <five> six\n\na\n\nb"
    assert text("") == "" and text("plain &eacute; text") == "plain é text"
    assert text("<p>a<div>b</div>c") == "a\n\nb\n\nc"
    assert text("<main>in</main><p>out</p>") == "in"
    assert text("<p>1 < 2 and <b>bold") == "1 < 2 and bold"
    assert text("<p>a <span class='ad'>buy</span> b<button>c</button>d") == "a b\n\nd"


def test_names_drop_only_what_they_name():
    for kept in ('<p title="a hidden gem">Keep</p>', '<h2 id="search">Keep</h2>', '<h2 class="share price">Keep</h2>', '<section class="related work">Keep</section>', '<div class="form factor">Keep</div>', '<p data-x="display:none">Keep</p>', "<p aria-hidden=false>Keep</p>"):
        assert text(f"<article>{kept}</article>") == "Keep", kept
    for gone in ("<p hidden>x</p>", '<p hidden="">x</p>', '<div style="color:red; DISPLAY : none">x</div>', '<div class="form">x</div>', '<div id="comments-list">x</div>', '<div class="ad ad-7">x</div>', '<div class="cookie-notice bottom">x</div>', "<div role=navigation>x</div>"):
        assert text(f"<article><p>Keep</p>{gone}</article>") == "Keep", gone
    for gone in ('<article class="comment">x</article>', '<article class="comment comment-12 even depth-1"><p>x</p></article>', '<div class="reader-comments">x</div>', '<div id="user-comments">x</div>', '<div class="article-comments">x</div>', '<div id="subnav">x</div>', '<div class="cookie-banner-v2">x</div>', '<ins class="adsbygoogle">x</ins>', '<div class="sponsored-post">x</div>'):
        assert text(f"<article><p>Keep</p>{gone}</article>") == "Keep", gone
        assert text(f"<p>Keep</p>{gone}") == "Keep", gone
    assert text('<article class="post">Keep</article>') == text('<article class="comment on events">Keep</article>') == "Keep"
    assert text("<p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here</p>") == "The energy is E=m here"
    assert text("<p>&am<b>p;</b> &amp;amp;</p>") == "&amp; &amp;"
    page = '<div id="page"><div class="site-header">x</div><article><div class="header">Keep</div></article></div>'
    assert text(page) == "Keep" and text('<div class="page header">x</div><p>Keep</p>') == "Keep"


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert text("<div>" * 20000 + "x" + "</div>" * 20000 + "</nav>" * 20000) == "x"
    assert time.perf_counter() - began < 5


def plain_importance(rows, params):
    """Importance of every style node by plain counting."""
    seen = {}
    for url, page in rows:
        host = url.split("://")[1].split("/")[0]
        below = {}
        for b in pages.blocks(page):
            keys = [(host, n) for n in dict.fromkeys(b.chain)] + [("", pages._claim_node(c)) for c in dict.fromkeys(b.claims)]
            for k in keys:
                below.setdefault(k, []).append((b.text, b.chain[-1]))
        for k, found in below.items():
            seen.setdefault(k, []).append(({t for t, _ in found}, tuple(dict.fromkeys(n for _, n in found))))
    out = {}
    for (host, node), shown in seen.items():
        m = len(shown)
        if m < params.pages:
            continue
        texts = collections.Counter(t for s, _ in shown for t in s)
        content = 1 - sum(math.log(k) for k in texts.values()) / len(texts) / math.log(m)
        styles = collections.Counter(s for _, s in shown)
        style = -sum(k / m * math.log(k / m) for k in styles.values()) / math.log(m)
        weight = params.decay ** len(styles) if host else 1.0
        out[host, pages._signed(node)] = (m, (1 - weight) * style + weight * content)
    return out


def test_importance_matches_a_plain_count(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    params = pages.Params()
    want = plain_importance([(r.url, r.html) for r in table.collect()], params)
    host, _ = pages.host_and_path(F.col("url"))
    got = {(r.host, r.node): (r.m, r.importance) for r in pages.importance(pages.style_nodes(table.select(host.alias("host"), "html")), params).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_the_tree_decides_on_adverts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    on = {r.page_id: r.text for r in pages.extract(table).collect()}
    off = {r.page_id: r.text for r in pages.extract(table.withColumn("html", F.expr("replace(replace(html, '<article>', '<div>'), '</article>', '</div>')")), pages.Params(tree=False)).collect()}
    assert all(off[k] != on[k] and off[k].endswith(on[k]) for k in on)  # without a tree every advert stays
    # What claims to be an advert and never repeats is none.
    rows = [(i, f"http://h{i % 9}.com/{i}", f"<div class='ad'>Only here {i}</div><p>text {i}</p>") for i in range(240)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in pages.extract(frame).collect()} == {f"Only here {i}\n\ntext {i}" for i in range(240)}
    again = frame.withColumn("html", F.regexp_replace("html", r"here \d+", "now"))
    assert {r.text for r in pages.extract(again).collect()} == {f"text {i}" for i in range(240)}
    assert {r.text for r in pages.extract(frame.where("page_id < 100")).collect()} == {f"text {i}" for i in range(100)}


def test_documents_come_back_from_their_pages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.extract(table).collect()
    assert len(rows) == table.count()
    import re

    for r in rows:
        doc = docs[int(re.search(r"://[^/]*/[a-z]+/(\d+)", r.url)[1])]
        want = "\n\n".join(" ".join(x.split()) for x in doc.split("\n") if x.strip())
        assert r.text.split("\n\n", 1)[1] == want and r.n_chars == len(r.text)


def test_the_style_tree_finds_what_a_host_repeats(spark):
    def page(i):
        return f"<body><div class='top'>Welcome to us</div><div class='main'><p>text {i} here</p><p>more {i * 7}</p></div><div class='low'>Call {i % 2}</div></body>"

    rows = [(i, f"http://h.com/{i}", page(i), "x", "y") for i in range(40)] + [(99, "http://other.com/", page(1), "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert got[3] == "text 3 here\n\nmore 21"
    assert got[99].startswith("Welcome to us")  # a host of one page shows nothing
    assert {r.page_id: r.text for r in pages.extract(frame, pages.Params(broadcast=0)).collect()} == got


def test_edges(spark):
    schema = "page_id long, url string, html string"
    assert pages.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None), (1, None, None), (2, "x", ""), (3, "http://a/", "<script>x"), (4, "http://a/", "<p>" + "w " * 200_000)]
    got = pages.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (1, 0), (2, 0), (3, 0), (4, 399_999)]
    same = spark.createDataFrame([(i, f"http://s.com/{i}", "<p>all the same</p>") for i in range(20)], schema)
    assert {r.text for r in pages.extract(same).collect()} == {"all the same"}
