"""Text expressions: ids, prompts, answers, normalised tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null, not empty, without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def post_permalink(permalink: Column) -> Column:
    """The first five parts of a comment's path, with the slash after them."""
    return extract(permalink, r"^(/[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/)")


def bare_id(fullname: Column) -> Column:
    """t1_abc -> abc."""
    return extract(fullname, r"^t[0-9]_([a-z0-9]*)")


def is_base_comment(parent: Column) -> Column:
    return parent.contains("t3_")


def quotes(text: Column) -> Column:
    """Lines that begin with an escaped > become quoted sentences."""
    return F.regexp_replace(text, r"(?m)^&gt;\s*(.*)$", '"$1"')


def slug(text: Column) -> Column:
    return F.translate(text, " /", "__")


def pretty(text: Column, prefix: str, names: dict[str, str]) -> Column:
    """A column name as a label: without prefix, in title case, or as named."""
    bare = F.initcap(F.replace(F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text), F.lit("_"), F.lit(" ")))
    for name, label in names.items():
        bare = F.when(text == name, F.lit(label)).otherwise(bare)
    return bare


def shortened(text: Column, n: int = 30) -> Column:
    return F.when(F.length(text) < n, text).otherwise(F.concat(F.left(text, F.lit(n)), F.lit("...")))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def wrapped(text: Column, width: int = 100) -> Column:
    """Broken at the first blank at or after every `width` characters, and ended by a line feed."""
    return F.concat(F.regexp_replace(text, rf"(.{{{width}}}[^ ]*) ", "$1\n"), F.lit("\n"))


def prompt(is_comment: Column, is_reply: Column, post: Column, parent: Column, text: Column) -> Column:
    """A post, a comment on a post, or a reply to a comment on a post."""
    return (
        F.when(~is_comment, F.concat(F.lit("Post: "), text))
        .when(~is_reply, F.concat(F.lit("Post: "), post, F.lit("\nComment: "), text))
        .otherwise(F.concat(F.lit("Post: "), post, F.lit("\nParent comment: "), parent, F.lit("\nComment: "), text))
    )


def joined(*parts: Column) -> Column:
    """Non-empty parts with blanks between; null if there is none."""
    given = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(given) > 0, F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), " "))


def parse_stance(answer: Column) -> Column:
    """favor, against or neutral: the first telling word of the first line."""
    words = F.regexp_extract_all(F.lower(F.split_part(answer, F.lit("\n"), F.lit(1))), F.lit(r"(\w+)"), F.lit(1))

    def told(word: Column) -> Column:
        agree = word.contains("favor") | word.contains("support") | (word.contains("agree") & ~word.contains("disagree"))
        return F.when(agree, "favor").when(word.contains("against") | word.contains("disagree"), "against").when(word.contains("neutral"), "neutral")

    return F.coalesce(F.get(F.filter(F.transform(words, told), lambda w: w.isNotNull()), F.lit(0)), F.lit("neutral"))


def parse_yes_no(answer: Column) -> Column:
    low = F.lower(answer)
    return F.when(low.contains("yes"), "yes").when(low.contains("no"), "no").otherwise("no")


def two_answers(favor: Column, against: Column) -> Column:
    """yes/no is favor, no/yes is against, all else neutral."""
    return F.when((favor == "yes") & (against == "no"), "favor").when((favor == "no") & (against == "yes"), "against").otherwise("neutral")


def suffix_label(answer: Column) -> Column:
    low = F.lower(F.trim(answer))
    return F.when(low.endswith("favor"), "favor").when(low.endswith("against"), "against").otherwise("neutral")


def field_of(text: Column, header: str) -> Column:
    """What follows a `Header:` up to the next line that begins with a header, or to ---."""
    body = F.split_part(text, F.lit("---"), F.lit(1))
    return extract(body, rf"(?s){header}:\s*(.*?)\s*(?:\n[A-Z][A-Za-z ]*:|\z)")


def year_month(path: Column) -> Column:
    return extract(path, r"(\d{4}-\d{2})")


def first_number(path: Column) -> Column:
    return extract(path, r"(\d+)").cast("int")


#: Label codes, their names and their numbers.
CODES = {"-2": "against", "-1": "against", "0": "neutral", "1": "favor", "2": "favor"}
VALUES = {"favor": 1, "against": -1, "neutral": 0}


def label_of_code(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in CODES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def value_of_label(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in VALUES.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def is_sentinel(text: Column) -> Column:
    """Null, empty, or the words that a data frame writes for nothing."""
    return text.isNull() | text.isin("", "Nan", "Null")


def is_blank(text: Column) -> Column:
    """Only white space of any script, or the invisible variation selector."""
    return text.rlike("(?U)^[\\s\\uFE0E]+$")


#: Tokens of short messages: links, users, tags, words with inner apostrophes and hyphens, numbers, runs of dots, single signs.
TOKEN = r"https?://\S+|www\.\S+|@[\p{L}\p{N}_]+|#[\p{L}\p{N}_]+|\p{N}+(?:[.,:/]\p{N}+)+|[\p{L}\p{N}_]+(?:['\-][\p{L}\p{N}_]+)*|\.{2,}|\S"


def sign_names() -> dict[str, str]:
    """The signs of the pictograph blocks as :name:, by their Unicode names."""
    blocks = [range(0x2600, 0x27C0), range(0x1F300, 0x1F650), range(0x1F680, 0x1F700), range(0x1F900, 0x1FA00)]
    names = {chr(i): unicodedata.name(chr(i), "") for block in blocks for i in block}
    return {c: ":" + n.lower().replace(" ", "_").replace("-", "_") + ":" for c, n in names.items() if n}


def tokens(text: Column) -> Column:
    """Tokens in order, with plain quotes and dots."""
    plain = F.replace(F.replace(text, F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


def normalized_tokens(text: Column, signs: bool = False) -> Column:
    """Tokens with users and links by a name; with `signs`, pictographs by theirs."""
    named = F.create_map(*[F.lit(x) for pair in sign_names().items() for x in pair]) if signs else None

    def one(token: Column) -> Column:
        low = F.lower(token)
        out = F.when(token.startswith("@") & (F.length(token) > 1), "@USER").when(low.startswith("http") | low.startswith("www"), "HTTPURL")
        if signs:
            # Few tokens are one sign beyond ASCII, so few look it up.
            out = out.when((F.length(token) == 1) & (F.octet_length(token) > 2), F.coalesce(F.try_element_at(named, token), token))
        return out.otherwise(token)

    return F.transform(tokens(text), one)


#: Contractions and times of day, as written after tokens were set apart.
REWRITES = [
    ("cannot ", "can not "), ("n't ", " n't "), ("n 't ", " n't "), ("ca n't", "can't"), ("ai n't", "ain't"),
    ("'m ", " 'm "), ("'re ", " 're "), ("'s ", " 's "), ("'ll ", " 'll "), ("'d ", " 'd "), ("'ve ", " 've "),
    (" p . m .", "  p.m."), (" p . m ", " p.m "), (" a . m .", " a.m."), (" a . m ", " a.m "),
]


def normalized(text: Column, signs: bool = False) -> Column:
    """Tokens joined by blanks, contractions and times of day set apart, white space squeezed."""
    out = F.array_join(normalized_tokens(text, signs), " ")
    for a, b in REWRITES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.split(out, " "), lambda t: t != ""), " ")


#: Common words that tell English.
ENGLISH = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "are", "this", "be", "at", "have", "not", "you", "i", "a")


def is_english(text: Column, least: float = 0.15) -> Column:
    """Whether enough words are common English ones; false for null and for texts without a letter."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    known = F.filter(words, lambda w: w.isin(*ENGLISH))
    return (F.size(words) > 0) & (F.size(known) >= least * F.size(words))


#: What an answer may consist of, by kind of question.
CHOICES = {"stance": ("favor", "against", "neutral"), "sided": ("yes", "no"), "polar": ("favor", "against")}


def choice_pattern(kind: str) -> str:
    """A pattern that only the choices of a kind match, in any case and with white space around."""
    return r"(?i)^\s*(" + "|".join(CHOICES[kind]) + r")\s*[.!]?\s*$"


def chosen(answer: Column, kind: str) -> Column:
    """The choice that an answer consists of, in lower case; null for any other answer."""
    return F.lower(extract(answer, choice_pattern(kind)))
