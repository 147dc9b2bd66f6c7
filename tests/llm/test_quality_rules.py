import collections
import re

from agora.llm.quality_rules import clean
from tests.llm.conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_counts_match_a_plain_count(spark, edge):
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    expected = {i: plain(t) for i, t in texts().items()}
    for frame, want in ((edge, expected), (more, {r.doc_id: plain(r.text) for r in more.collect()})):
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in clean(frame).collect()}
        assert got == want


def test_lines_decide(spark, nothing):
    good = "\n".join(f"Word{i} plain{i} sentence{i} holds{i} good{i} number{i} of{i} others{i}." for i in range(12))
    menu = "\n".join(f"home | about{i} | shop{i} | cart{i} | help{i} | blog{i}" for i in range(20))
    cases = {1: good, 2: menu, 3: good + "\n" + menu.split("\n")[0], 4: good.upper(), 5: good + "\nAll rights reserved.", 6: None, 7: ""}
    frame = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.lost_words) for r in clean(frame).collect()}
    assert [got[i][0] for i in range(1, 8)] == [True, False, True, False, True, False, False]
    assert got[1][1] == 0 and got[5][1] == 3
    assert clean(nothing).count() == 0


def test_failed_lines_leave_the_text(spark):
    good = "\n".join(f"Word{i} plain{i} sentence{i} holds{i} good{i}." for i in range(4))
    bad = "home | about | shop | cart"
    cases = {1: good, 2: f"{bad}\n{good}", 3: f"{good}\n{bad}", 4: f"{good}\n\n{bad}\n{bad}\nEnd é here.", 5: bad, 6: None, 7: f"{bad}\n", 8: "Next text."}
    frame = spark.createDataFrame(list(cases.items()), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.clean_text for r in clean(frame, cleaned=True).collect()}
    assert got == {1: good, 2: good, 3: good + "\n", 4: good + "\n\nEnd é here.", 5: "", 6: "", 7: "", 8: "Next text."}
