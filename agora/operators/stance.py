"""Stance of texts by a pluggable model; the default is a rule on words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions import text as tx

Model = Callable[[list[str]], list[str]]


def asked_of(prompts: Column, model: Model) -> Column:
    """The model's answer to each prompt; only the prompts go to Python, a few hundred to the model at once."""

    def run(part: pd.Series) -> pd.Series:
        texts, out = part.fillna("").tolist(), []
        for at in range(0, len(texts), 256):
            out += model(texts[at : at + 256])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(prompts)


def ask(rows: DataFrame, prompt: Column, model: Model, name: str) -> DataFrame:
    """rows with the model's answer to a prompt, asked in Arrow batches."""
    return rows.withColumn(name, asked_of(prompt, model))


def one_step(rows: DataFrame, target: str, text: str, model: Model | None = None) -> DataFrame:
    """stance from one answer; without a model the text itself is read as the answer."""
    if model is None:
        return rows.withColumn("stance", tx.parse_stance(F.col(text)))
    asked = ask(rows, F.concat(F.lit(f"What is the stance on {target}?\n"), F.col(text)), model, "_answer")
    return asked.withColumn("stance", tx.parse_stance(F.col("_answer"))).drop("_answer")


def two_step(rows: DataFrame, target: str, text: str, model: Model) -> DataFrame:
    """neutral unless the text is said to bear on the target; then one_step."""
    asked = ask(rows, F.concat(F.lit(f"Does this take a side on {target}?\n"), F.col(text)), model, "_sided")
    told = one_step(asked, target, text, model)
    return told.withColumn("stance", F.when(tx.parse_yes_no(F.col("_sided")) == "yes", F.col("stance")).otherwise("neutral")).drop("_sided")


def yes_no(rows: DataFrame, target: str, text: str, model: Model) -> DataFrame:
    """stance from two questions: is it for, is it against."""
    for side in ("for", "against"):
        rows = ask(rows, F.concat(F.lit(f"Is this {side} {target}?\n"), F.col(text)), model, f"_{side}")
    both = tx.two_answers(tx.parse_yes_no(F.col("_for")), tx.parse_yes_no(F.col("_against")))
    return rows.withColumn("stance", both).drop("_for", "_against")


@dataclass(frozen=True)
class Schema:
    """How a question is put: an instruction with {target} and {explanation}, the inputs it shows, and how answers are read."""

    instruction: str
    inputs: tuple[tuple[str, str], ...]  # (label, column)
    answer: str  # the label before the answer
    kind: str = "stance"  # stance, sided (yes or no, then a stance) or polar (yes or no)

    def prompt(self, target: str, explanation: str, columns: dict[str, Column]) -> Column:
        """The instruction, a line for each input that the row has, and the answer's label."""
        parts = [F.lit(self.instruction.format(target=target, explanation=explanation) + "\n")]
        for label, column in self.inputs:
            parts.append(F.coalesce(F.concat(F.lit(f"{label}: "), columns[column], F.lit("\n")), F.lit("")))
        return F.concat(*parts, F.lit(f"{self.answer}:"))


_CONTEXT = (("Post", "post"), ("Parent comment", "parent"), ("Comment", "comment"))
#: The ways to ask, by name.
SCHEMAS = {
    "onestep": Schema("Does the comment agree with {target}, disagree with it, or neither? {explanation}", _CONTEXT, "Opinion"),
    "template": Schema("Say whether the comment is in favor of {target}, against it, or neutral. {target} means: {explanation}", _CONTEXT, "Stance"),
    "twostep": Schema("Does the comment hold an opinion on {target}, and if so, does it agree? {explanation}", _CONTEXT, "Opinion present", "sided"),
    "yesno": Schema("Does the comment agree with this: {target}? {explanation}", _CONTEXT, "Answer", "polar"),
    "post": Schema("What stance does the post take on {target}? {explanation}", (("Post", "post"),), "Stance"),
}
PROMPTING = ("predict", "multicomparison", "chainofthought", "multichaincomparison")


def classify(rows: DataFrame, method: str, prompting: str, target: str, against: str, explanation: str, model: Model, attempts: int = 3) -> DataFrame:
    """rows of (post, parent, comment) with the stance that a model's answers give.

    method names one of SCHEMAS; yesno asks for the target and for its opposite `against`.
    prompting: one answer; the most frequent of several (the first of equals); reasons
    first, then the stance they end with; or a last answer after several attempts at reasons.
    """
    if method not in SCHEMAS:
        raise ValueError(f"unknown method {method}")
    if prompting not in PROMPTING:
        raise ValueError(f"unknown prompting {prompting}")
    schema = SCHEMAS[method]
    columns = {c: F.col(c) for c in ("post", "parent", "comment")}

    def asked(rows: DataFrame, about: str, name: str) -> DataFrame:
        question = schema.prompt(about, explanation, columns)
        if prompting == "predict":
            return ask(rows, question, model, name)
        if prompting == "chainofthought":
            told = ask(rows, F.concat(question, F.lit(" Let us think step by step.")), model, "_reasons")
            return told.withColumn(name, F.element_at(F.split("_reasons", "\n"), -1)).drop("_reasons")
        tries = [f"_try{k}" for k in range(attempts)]
        # Side by side, so that one Python worker of a task answers them all.
        rows = rows.withColumns({c: asked_of(F.concat(question, F.lit(f" (attempt {k + 1})")), model) for k, c in enumerate(tries)})
        if prompting == "multichaincomparison":
            said = [F.concat(F.lit(f"\nAttempt {k + 1}: "), F.split_part(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(1)), F.lit(" (not sure)")) for k, c in enumerate(tries)]
            return ask(rows, F.concat(question, *said), model, name).drop(*tries)
        every = F.array(*[read_answer(F.col(c), schema.kind) for c in tries])
        often = F.transform(every, lambda a, i: F.struct(F.size(F.filter(every, lambda b: b == a)).alias("n"), (-i).alias("i"), a.alias("a")))
        return rows.withColumn(name, F.array_max(often)["a"]).drop(*tries)

    if schema.kind == "polar":
        rows = asked(asked(rows, target, "_for"), against, "_against")
        both = tx.two_answers(tx.parse_yes_no(F.col("_for")), tx.parse_yes_no(F.col("_against")))
        return rows.withColumn("stance", both).drop("_for", "_against")
    rows = asked(rows, target, "_answer")
    return rows.withColumn("stance", read_answer(F.col("_answer"), schema.kind)).drop("_answer")


def read_answer(answer: Column, kind: str) -> Column:
    if kind == "polar":
        return tx.parse_yes_no(answer)
    if kind == "sided":
        sided = tx.parse_yes_no(F.split_part(answer, F.lit("\n"), F.lit(1))) == "yes"
        return F.when(sided, tx.parse_stance(F.element_at(F.split(answer, "\n"), -1))).otherwise("neutral")
    return tx.parse_stance(answer)


def merged_tasks(tasks: dict[str, DataFrame], split: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Rows of several tasks with their task's name, and a place in each split's common order, drawn by hash."""
    from agora.functions import draws
    from agora.operators.ordered import numbered

    out = None
    for name, rows in tasks.items():
        one = rows.withColumn("task", F.lit(name))
        out = one if out is None else out.unionByName(one)
    drawn = out.withColumn("_draw", draws.uniform(seed, "task", *keys))
    return numbered(drawn, [split], [F.col("_draw"), F.col("task"), *map(F.col, keys)]).drop("_draw", "place_of")
