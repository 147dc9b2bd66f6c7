"""Scores of predicted labels, and agreement of annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("favor", "against", "neutral")


def or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return or_zero((1 + b2) * precision * recall, b2 * precision + recall)


def confusion(rows: DataFrame, keys: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Counts of every gold and predicted label of CLASSES; rows of other labels raise."""
    for c in (gold, predicted):
        rows = rows.withColumn(c, F.when(F.col(c).isin(*CLASSES), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(c), F.lit("null"))))))
    return rows.groupBy(*keys, gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(counts: DataFrame, keys: list[str], beta: float = 0.5) -> DataFrame:
    """precision, recall, f1 and f_beta of each class; all 0 for a class that gold lacks."""
    label = F.explode(F.array(*map(F.lit, CLASSES))).alias("label")
    rows = counts.select(*keys, "gold", "predicted", "n", label)
    n = F.col("n")
    rows = rows.groupBy(*keys, "label").agg(
        F.sum(F.when((F.col("gold") == F.col("label")) & (F.col("predicted") == F.col("label")), n).otherwise(0)).cast("double").alias("hit"),
        F.sum(F.when(F.col("predicted") == F.col("label"), n).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("gold") == F.col("label"), n).otherwise(0)).alias("support"),
    )
    p, r = or_zero(F.col("hit"), F.col("said")), or_zero(F.col("hit"), F.col("support"))
    rows = rows.withColumn("precision", F.when(F.col("support") > 0, p).otherwise(0.0)).withColumn("recall", r)
    p, r = F.col("precision"), F.col("recall")
    return rows.select(*keys, "label", "support", "precision", "recall", f_beta(p, r).alias("f1"), f_beta(p, r, beta).alias("f_beta"))


def macro(metrics: DataFrame, keys: list[str], column: str = "f1") -> DataFrame:
    """The mean over favor and against, of those that gold has; 0 if it has neither."""
    there = F.col("label").isin("favor", "against") & (F.col("support") > 0)
    return metrics.groupBy(*keys).agg(F.coalesce(F.avg(F.when(there, F.col(column))), F.lit(0.0)).alias("macro"))


def majority(votes: DataFrame, item: str, label: str, draw: str) -> DataFrame:
    """The label most drawn for each item; the one seen first of equally frequent ones."""
    counts = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("first"))
    n = F.row_number().over(Window.partitionBy(item).orderBy(F.col("n").desc(), "first"))
    return counts.withColumn("_r", n).where("_r = 1").select(item, label)


def label_counts(votes: DataFrame, keys: list[str], item: str, label: str = "label") -> DataFrame:
    """A row for each item with a count for each of CLASSES; items with fewer than two votes go, other labels raise."""
    known = F.when(F.col(label).isin(*CLASSES), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(label), F.lit("null")))))
    counts = [F.count(F.when(F.col("_label") == c, 1)).alias(c) for c in CLASSES]
    rows = votes.withColumn("_label", known).groupBy(*keys, item).agg(*counts)
    return rows.where(sum((F.col(c) for c in CLASSES), F.lit(0)) >= 2)


def agreement(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Fleiss' kappa, and the shares of unanimous items and of complete disagreement (no neutral vote)."""
    n = sum((F.col(c) for c in CLASSES), F.lit(0))
    squares = sum((F.col(c) * F.col(c) for c in CLASSES), F.lit(0))
    rows = counts.withColumn("_n", n).withColumn("_p", (squares - n) / (n * (n - 1)))
    whole = F.greatest(*(F.col(c) for c in CLASSES)) == F.col("_n")
    sums = rows.groupBy(*keys).agg(
        F.avg("_p").alias("_p"),
        F.sum("_n").alias("_all"),
        *[F.sum(c).alias(c) for c in CLASSES],
        F.avg(F.when(whole, 1.0).otherwise(0.0)).alias("unanimous"),
        F.avg(F.when(~whole & (F.col("neutral") == 0), 1.0).otherwise(0.0)).alias("disagreement"),
    )
    chance = sum((F.pow(F.col(c) / F.col("_all"), F.lit(2.0)) for c in CLASSES), F.lit(0.0))
    kappa = F.try_divide(F.col("_p") - chance, 1 - chance)
    return sums.select(*keys, F.coalesce(kappa, F.lit(1.0)).alias("kappa"), "unanimous", "disagreement")


def gold(first: DataFrame, adjudicated: DataFrame, item: str, label: str = "label") -> DataFrame:
    """The adjudicated label where there is one, else the first annotator's."""
    other = adjudicated.select(item, F.col(label).alias("_other"))
    return first.join(other, item, "left").select(item, F.coalesce("_other", label).alias(label))


def constant(rows: DataFrame, label: str) -> DataFrame:
    """rows as a classifier that always says `label` predicts them."""
    return rows.withColumn("predicted", F.lit(label))


def annotator_as_classifier(votes: DataFrame, gold: DataFrame, item: str, annotator: str, who) -> DataFrame:
    """(item, gold, predicted): an annotator's labels against the gold ones."""
    said = votes.where(F.col(annotator) == who).select(item, F.col("label").alias("predicted"))
    return said.join(gold.select(item, F.col("label").alias("gold")), item)


def averaged(metrics: DataFrame, keys: list[str], over: list[str], columns: list[str]) -> DataFrame:
    """The mean of each metric over `over`, for each key; a key that lacks some is the mean of those it has."""
    rows = metrics.groupBy(*keys, *over).agg(*[F.avg(c).alias(c) for c in columns])
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))


def to_adjudicate(counts: DataFrame, item: str, before: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Items whose votes differ, and whether `before` lists the same ones, so that it may be used again."""
    open_ = counts.where(F.greatest(*(F.col(c) for c in CLASSES)) < sum((F.col(c) for c in CLASSES), F.lit(0)))
    if before is None:
        return open_, False
    from agora.operators.relational import same_rows

    return open_, bool(same_rows(open_.select(item).distinct(), before.select(item).distinct()).first()["same"])
