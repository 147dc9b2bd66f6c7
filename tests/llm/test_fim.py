import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import fim


def plain(doc_id, text, params=fim.Params()):
    """n, form, characters of prefix and middle, and output."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{params.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = params.prefix, params.suffix, params.middle
    if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= params.rate:
        return n, "plain", None, None, text
    if h4 % 100 < params.suffix_first:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def test_rank_and_select():
    rnd = np.random.default_rng(3)
    for size, density in ((0, 0.5), (1, 1.0), (63, 0.2), (64, 0.9), (5000, 0.01), (5000, 0.99), (70_000, 0.3)):
        bits = rnd.random(size) < density
        borders = fim.Borders(bits)
        assert borders.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        assert borders.select(np.arange(1, bits.sum() + 1)).tolist() == np.flatnonzero(bits).tolist()


@pytest.mark.parametrize("params", [fim.Params(), fim.Params(seed=1, rate=40, suffix_first=80, prefix="[p", suffix="[s]", middle="[m")])
def test_texts(spark, edge, nothing, params):
    rnd = random.Random(5)
    odd = ["", "\n", "\n\n\n", "a", "a\n", "\na", "<", "<P", "a\n<S", "x<P>y\nz", "[p] q\n[s]\n", "é\n漢\n😀\n", "b" * 300_000 + "\nend", None]
    odd += ["".join(rnd.choice("ab\né<") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    made = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(odd, 1000)], "doc_id long, text string").repartition(2)
    rows = fim.fill_in_middle(edge.select("doc_id", "text").unionByName(made), params)
    texts = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").unionByName(made).collect()]
    want = sorted((str(i), *map(str, plain(i, t, params)), t or "") for i, t in texts)
    found = rows.select("*", fim.restored(F.col("output"), F.col("form"), params).alias("back")).collect()
    assert sorted((str(r.doc_id), *(str(r[k]) for k in ("n", "form", "prefix_chars", "middle_chars", "output")), r.back) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(nothing, params).count() == 0


def test_clashing_names(spark, edge):
    assert fim.fill_in_middle(edge.withColumn("n", F.lit(1)).withColumn("form", F.lit("x")).withColumn("output", F.lit("x"))).count() == edge.count()


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P>", "x<", "<M>")])
def test_sentinels_that_cannot_be_told_apart(marks):
    with pytest.raises(ValueError):
        fim.Params(prefix=marks[0], suffix=marks[1], middle=marks[2])
