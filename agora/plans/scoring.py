"""Scores and agreement over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators import scoring as sc
from agora.plans.opinions import rounded
from agora.registry import query
from agora.tables import read

#: Gold from the labels, a prediction from length, and three annotators from fixed rules.
PAIR_SQL = """pair AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'against' WHEN quality = 1 THEN 'favor' ELSE 'neutral' END AS gold,
  CASE WHEN n_chars % 5 = 0 THEN 'against' WHEN n_chars > 900 THEN 'favor' ELSE 'neutral' END AS predicted, n_chars FROM labels JOIN documents USING (doc_id))"""
VOTE_SQL = f"""{PAIR_SQL}, vote AS (SELECT doc_id, lang, 0 AS annotator, gold AS label FROM pair UNION ALL SELECT doc_id, lang, 1, CASE WHEN doc_id % 4 = 0 THEN predicted ELSE gold END FROM pair UNION ALL SELECT doc_id, lang, 2, CASE WHEN doc_id % 3 = 0 THEN predicted ELSE gold END FROM pair)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    gold = F.when(F.col("toxic") == 1, "against").when(F.col("quality") == 1, "favor").otherwise("neutral")
    said = F.when(F.col("n_chars") % 5 == 0, "against").when(F.col("n_chars") > 900, "favor").otherwise("neutral")
    return rows.select("doc_id", "lang", gold.alias("gold"), said.alias("predicted"), "n_chars")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    labels = [F.col("gold"), *(F.when(F.col("doc_id") % k == 0, F.col("predicted")).otherwise(F.col("gold")) for k in (4, 3))]
    drawn = F.explode(F.array(*[F.struct(F.lit(i).alias("annotator"), c.alias("label")) for i, c in enumerate(labels)])).alias("v")
    return rows.select("doc_id", "lang", drawn).select("doc_id", "lang", "v.*")


@query(f"WITH {PAIR_SQL} SELECT lang, gold, predicted, count(*) AS n FROM pair GROUP BY 1, 2, 3")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.confusion(pairs(spark, sf_dir), ["lang"])


METRIC_SQL = f"""{PAIR_SQL}, hit AS (SELECT lang, label, CAST(count(*) FILTER (gold = label AND predicted = label) AS DOUBLE) AS hit, count(*) FILTER (predicted = label) AS said, count(*) FILTER (gold = label) AS support FROM pair, (VALUES ('favor'), ('against'), ('neutral')) l(label) GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN support > 0 THEN coalesce(hit / nullif(said, 0), 0) ELSE 0 END AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM hit),
metric AS (SELECT lang, label, support, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0) AS f_beta FROM pr)"""


@query(f"WITH {METRIC_SQL} SELECT lang, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f_beta, 6) AS f_beta FROM metric")
def stance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sc.confusion(pairs(spark, sf_dir), ["lang"])
    return rounded(sc.class_metrics(counts, ["lang"]), "precision", "recall", "f1", "f_beta")


@query(f"WITH {METRIC_SQL} SELECT lang, round(coalesce(avg(f1) FILTER (label <> 'neutral' AND support > 0), 0), 6) AS macro FROM metric GROUP BY 1")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sc.confusion(pairs(spark, sf_dir), ["lang"])
    return rounded(sc.macro(sc.class_metrics(counts, ["lang"]), ["lang"]), "macro")


@query(f"WITH {PAIR_SQL} SELECT doc_id, gold, predicted FROM pair WHERE gold <> predicted")
def incorrect_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).where("gold <> predicted").select("doc_id", "gold", "predicted")


@query(f"WITH {VOTE_SQL} SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(annotator)) AS r FROM vote GROUP BY 1, 2) WHERE r = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.majority(votes(spark, sf_dir), "doc_id", "label", "annotator")


COUNT_SQL = f"{VOTE_SQL}, cnt AS (SELECT lang, doc_id, count(*) FILTER (label = 'favor') AS favor, count(*) FILTER (label = 'against') AS against, count(*) FILTER (label = 'neutral') AS neutral FROM vote GROUP BY 1, 2)"


@query(f"""WITH {COUNT_SQL}, s AS (SELECT lang, avg((favor * favor + against * against + neutral * neutral - 3) / 6.0) AS p, CAST(sum(favor) AS DOUBLE) / (3 * count(*)) AS a, CAST(sum(against) AS DOUBLE) / (3 * count(*)) AS b, CAST(sum(neutral) AS DOUBLE) / (3 * count(*)) AS c, avg(CASE WHEN greatest(favor, against, neutral) = 3 THEN 1.0 ELSE 0.0 END) AS unanimous, avg(CASE WHEN greatest(favor, against, neutral) < 3 AND neutral = 0 THEN 1.0 ELSE 0.0 END) AS disagreement FROM cnt GROUP BY 1)
SELECT lang, round(coalesce((p - (a * a + b * b + c * c)) / nullif(1 - (a * a + b * b + c * c), 0), 1), 3) AS kappa, round(unanimous, 6) AS unanimous, round(disagreement, 6) AS disagreement FROM s""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.agreement(sc.label_counts(votes(spark, sf_dir), ["lang"], "doc_id"), ["lang"])
    return rounded(rows, "unanimous", "disagreement").withColumn("kappa", F.round("kappa", 3))


@query(f"WITH {COUNT_SQL} SELECT doc_id, favor, against, neutral FROM cnt WHERE greatest(favor, against, neutral) < 3")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.label_counts(votes(spark, sf_dir), ["lang"], "doc_id")
    return rows.where("greatest(favor, against, neutral) < 3").select("doc_id", "favor", "against", "neutral")


@query(f"WITH {VOTE_SQL} SELECT a.doc_id, coalesce(b.label, a.label) AS label FROM vote a LEFT JOIN (SELECT doc_id, label FROM vote WHERE annotator = 2 AND doc_id % 2 = 0) b USING (doc_id) WHERE a.annotator = 0")
def adjudicated_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = votes(spark, sf_dir)
    return sc.gold(rows.where("annotator = 0"), rows.where("annotator = 2 and doc_id % 2 = 0"), "doc_id")


BASE_SQL = f"""{PAIR_SQL}, base AS (SELECT lang, said, gold, said AS predicted FROM pair, (VALUES ('favor'), ('against'), ('neutral')) s(said)),
bhit AS (SELECT lang, said, label, CAST(count(*) FILTER (gold = label AND predicted = label) AS DOUBLE) AS hit, count(*) FILTER (predicted = label) AS all_said, count(*) FILTER (gold = label) AS support FROM base, (VALUES ('favor'), ('against'), ('neutral')) l(label) GROUP BY 1, 2, 3),
bpr AS (SELECT *, CASE WHEN support > 0 THEN coalesce(hit / nullif(all_said, 0), 0) ELSE 0 END AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM bhit),
bf AS (SELECT lang, said, label, support, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM bpr), bm AS (SELECT lang, said, coalesce(avg(f1) FILTER (label <> 'neutral' AND support > 0), 0) AS macro FROM bf GROUP BY 1, 2)"""


@query(f"WITH {BASE_SQL} SELECT lang, said, round(macro, 6) AS macro FROM bm")
def constant_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro scores of classifiers that always say the same."""
    rows = pairs(spark, sf_dir).drop("predicted")
    every = None
    for label in sc.CLASSES:
        one = sc.constant(rows, label).withColumn("always", F.lit(label))
        every = one if every is None else every.unionByName(one)
    metrics = sc.class_metrics(sc.confusion(every, ["lang", "always"]), ["lang", "always"])
    return rounded(sc.macro(metrics, ["lang", "always"]).withColumnRenamed("always", "said"), "macro")


@query(f"WITH {BASE_SQL} SELECT said, round(avg(macro), 6) AS macro, count(*) AS n FROM bm GROUP BY 1")
def averaged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baselines' scores averaged over stances (here languages)."""
    return rounded(sc.averaged(constant_baselines(spark, sf_dir), ["said"], ["lang"], ["macro"]), "macro")


@query(f"WITH {VOTE_SQL} SELECT a.lang, b.label AS gold, a.label AS predicted, count(*) AS n FROM vote a JOIN vote b ON a.doc_id = b.doc_id AND b.annotator = 0 WHERE a.annotator = 1 GROUP BY 1, 2, 3")
def annotator_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotator's labels scored against another's as if they were a classifier's."""
    rows = votes(spark, sf_dir)
    scored = sc.annotator_as_classifier(rows, rows.where("annotator = 0"), "doc_id", "annotator", 1)
    return sc.confusion(scored.join(rows.where("annotator = 0").select("doc_id", "lang"), "doc_id"), ["lang"])


@query(f"WITH {PAIR_SQL} SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS epoch, round(avg(CASE WHEN gold <> predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS loss, count(*) AS n FROM pair GROUP BY 1, 2")
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("epoch", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    loss = F.avg(F.when(F.col("gold") != F.col("predicted"), 1.0).otherwise(0.0)).alias("loss")
    return rounded(rows.groupBy("lang", "epoch").agg(loss, F.count(F.lit(1)).alias("n")), "loss")


@query(f"WITH {COUNT_SQL} SELECT doc_id, favor, against, neutral, TRUE AS again, FALSE AS changed FROM cnt WHERE greatest(favor, against, neutral) < favor + against + neutral")
def reused_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreements, whether the list of them is still the same, and that a shorter list is not."""
    counts = sc.label_counts(votes(spark, sf_dir), ["lang"], "doc_id")
    open_, _ = sc.to_adjudicate(counts, "doc_id")
    again = sc.to_adjudicate(counts, "doc_id", open_)[1]
    changed = sc.to_adjudicate(counts, "doc_id", open_.orderBy("doc_id").limit(1))[1]
    return open_.select("doc_id", "favor", "against", "neutral", F.lit(again).alias("again"), F.lit(changed).alias("changed"))
