import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, component_id string, n_shingles string, length string, bucket int"


def thue_morse(n):
    """A word of a and b whose complement has the same polynomial hash modulo 2**64, whatever the odd base."""
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def texts():
    """Edge cases, copies, near copies and random texts, by doc_id."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ñu", "漢字", "it's", "a,b", "#x", "|"]
    base = [" ".join(rnd.choice(words) for _ in range(n)) + "." for n in (60, 80, 120, 200, 33, 51)]
    out = [None, "", " \n\t ", "one", "one two", "ONE two three", "one two three four", "a b a b a b a b a b", "x\nx\nx y\nx y\n\n\n", "é" * 50, "w " * 3000, "漢" * 700, "<|endoftext|> a", "hi <|endoftext|><|endoftext|> a <|endoftext", thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))]
    for text in base:
        parts = text.split(" ")
        out += [text, text, text.upper(), text.lower(), " ".join(["new", *parts[1:]]), " ".join(parts[: len(parts) // 2]), " ".join(parts[:-3]), text + " extra tail here", " ".join(parts[::-1])]
    for _ in range(40):
        out.append(" ".join(rnd.choice(words[:30]) for _ in range(rnd.randint(1, 12))))
    return dict(enumerate(out, start=5))


@pytest.fixture(scope="session")
def edge(spark):
    """Texts with extra columns of clashing names; the last rows repeat the first."""
    rows = [(i, t, None, None, None, "x", "y", "z", None, 3) for i, t in texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
