"""Topics of documents from embeddings: reduce, cluster, describe."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import vectors as vec
from agora.operators import density, reduction
from agora.operators import neighbours as nb

OUTLIER = -1


@dataclass
class TopicModel:
    """Principal components and topic centers, and how far from its center a topic reaches.

    All of it is k vectors of a few numbers, so it can be applied to any corpus, merged,
    ordered into a tree and kept.
    """

    components: np.ndarray | None  # dimensions x reduced, or None where vectors are used as they are
    centers: np.ndarray  # topics x reduced
    reach: np.ndarray  # distance beyond which a vector is an outlier
    names: list[int]  # the topic of each center

    def apply(self, rows: DataFrame, column: str = "embedding") -> DataFrame:
        """rows with `reduced`, topic (OUTLIER beyond every reach) and distance to its center."""
        values = F.transform(column, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
        if self.components is not None:
            values = F.array(*[vec.dot(values, F.array(*map(F.lit, part.tolist()))) for part in self.components.T])
        rows = rows.withColumn("reduced", values)
        each = [F.struct(vec.euclid(F.col("reduced"), F.array(*map(F.lit, c.tolist()))).alias("d"), F.lit(int(n)).alias("n"), F.lit(float(r)).alias("r")) for c, n, r in zip(self.centers, self.names, self.reach, strict=True)]
        rows = rows.withColumn("_near", F.array_min(F.array(*each)))
        topic = F.when(F.col("_near.d") > F.col("_near.r"), OUTLIER).otherwise(F.col("_near.n"))
        return rows.withColumn("topic", topic).withColumn("distance", F.col("_near.d")).drop("_near")

    def merged(self, most: int) -> TopicModel:
        """At most so many topics: the two whose centers are nearest become one (the smaller number), again and again."""
        names = list(self.names)
        while len(set(names)) > most:
            _, a, b = min(self._gaps(names))
            names = [a if n == b else n for n in names]
        return TopicModel(self.components, self.centers, self.reach, names)

    def _gaps(self, names: list[int]) -> list[tuple[float, int, int]]:
        mean = {n: self.centers[[i for i, m in enumerate(names) if m == n]].mean(0) for n in sorted(set(names))}
        return [(float(np.linalg.norm(mean[a] - mean[b])), a, b) for a in mean for b in mean if a < b]

    def tree(self) -> list[tuple[int, int, float]]:
        """The merges down to one topic in order: (stays, goes, distance)."""
        out, names = [], list(self.names)
        while len(set(names)) > 1:
            d, a, b = min(self._gaps(names))
            out.append((a, b, d))
            names = [a if n == b else n for n in names]
        return out


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("_v", array_to_vector(F.transform(column, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))))


def fit(rows: DataFrame, k: int, reduced: int | None = 5, share: float = 0.2, farthest: float = 3.0, key: str = "vec_id", column: str = "embedding", seed: int = 0, hierarchical: bool = False) -> TopicModel:
    """Topics of a share of the rows, drawn by hash of their key: components, then k-means or bisecting k-means.

    The model is k centers and the reach of each, `farthest` times its mean distance, so it
    can be kept and applied to other rows; density_topics() finds topics by density.
    """
    from agora.operators.relational import hash_sample

    sample = _vectors(hash_sample(rows, [key], share, seed) if share < 1 else rows, column)
    components = None
    if reduced:
        model = PCA(k=reduced, inputCol="_v", outputCol="_r").fit(sample)
        components = model.pc.toArray()
        sample = model.transform(sample).withColumn("_v", F.col("_r"))
    kind = BisectingKMeans if hierarchical else KMeans
    model = kind(k=k, seed=seed, featuresCol="_v", predictionCol="_t").fit(sample)
    centers = np.array([c.tolist() for c in model.clusterCenters()])
    whole = TopicModel(components, centers, np.full(len(centers), np.inf), list(range(len(centers))))
    means = {r["topic"]: r["d"] for r in whole.apply(sample, column).groupBy("topic").agg(F.avg("distance").alias("d")).collect()}
    return TopicModel(components, centers, np.array([farthest * means.get(i, 0.0) for i in range(len(centers))]), whole.names)


def density_topics(rows: DataFrame, size: int, key: str = "vec_id", column: str = "embedding", dims: int | None = 5, neighbours: int = 10, cosine: bool = True) -> DataFrame:
    """(key, topic): topics of at least `size` rows where vectors lie densely, OUTLIER elsewhere.

    Vectors go through a spectral reduction to `dims` dimensions (None: as they are), which
    keeps neighbourhoods that bend, and then into density clusters, of which there may be
    any number. See operators.reduction and operators.density for both. Keys are longs.
    """
    unit = rows.select(key, (nb.unit(column) if cosine else nb.clean(column)).alias("e"))
    if dims and unit.where("e is not null and size(e) > 0").limit(1).count():
        unit = reduction.fit(unit, dims, key, "e").transform(unit, "e", "e")
    return density.clusters(unit, key, "e", size, neighbours).withColumnRenamed("cluster", "topic")


def within_topics(rows: DataFrame, model: TopicModel, k: int, key: str = "vec_id", column: str = "embedding", **how) -> DataFrame:
    """rows with a topic and a subtopic of it, from a model fitted inside each topic; outliers have subtopic OUTLIER."""
    placed = model.apply(rows, column).drop("reduced", "distance")
    out = placed.where(F.col("topic") == OUTLIER).withColumn("subtopic", F.lit(OUTLIER))
    for topic in sorted(set(model.names)):
        own = placed.where(F.col("topic") == topic)
        inner = fit(own, k, key=key, column=column, **how).apply(own, column).drop("reduced", "distance") if own.limit(k).count() == k else None
        # The inner model names its topics in the column of the outer ones.
        found = own.withColumn("subtopic", F.lit(0)) if inner is None else inner.withColumnRenamed("topic", "subtopic").withColumn("topic", F.lit(topic))
        out = out.unionByName(found)
    return out


def run_name(**settings) -> str:
    """A run's name from its parameters, in order of their names."""
    return "_".join(f"{k}-{str(v).replace('/', '-')}" for k, v in sorted(settings.items()))


def topic_info(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def topic_words(rows: DataFrame, topic: str, words: Column, k: int = 10) -> DataFrame:
    """The k words of each topic with the largest class TF-IDF: share in the topic times log(1 + mean words of a topic / count)."""
    counts = rows.select(topic, F.explode(words).alias("word")).where("word <> ''").groupBy(topic, "word").agg(F.count(F.lit(1)).alias("n"))
    by_topic, by_word = Window.partitionBy(topic), Window.partitionBy("word")
    totals = counts.groupBy(topic).agg(F.sum("n").alias("size"))
    mean = totals.agg(F.avg("size").alias("mean"))
    scored = counts.withColumn("all", F.sum("n").over(by_word)).join(F.broadcast(totals), topic).join(F.broadcast(mean))
    scored = scored.withColumn("score", F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("all")))
    n = F.row_number().over(by_topic.orderBy(F.round("score", 9).desc(), "word"))
    return scored.withColumn("rank", n.cast("long")).where(F.col("rank") <= k).select(topic, "rank", "word", "n", "score")


def hashed_embedding(rows: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """A deterministic stand-in for a text model: signed hashes of words, of length 1."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\W+"), lambda w: w != "")
    counts = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_w", words)
    zero = F.array_repeat(F.lit(0.0), dims)

    def add(v: Column, w: Column) -> Column:
        place, sign = F.pmod(F.xxhash64(w), F.lit(dims)), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        return F.transform(v, lambda x, i: x + F.when(i == place, sign).otherwise(0.0))

    v = F.aggregate("_w", zero, add)
    counts = counts.withColumn("embedding", v)
    size = vec.norm(F.col("embedding"))
    return counts.withColumn("embedding", F.transform("embedding", lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))).drop("_id", "_w")
