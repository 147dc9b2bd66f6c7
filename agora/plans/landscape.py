"""Correlation, density and polarization over events."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.functions import vectors as vec
from agora.functions.draws import poisson_sql, uniform_sql
from agora.operators import landscape as la
from agora.operators import opinions as op
from agora.operators.interactions import means_around
from agora.plans.opinions import VAR_SQL, WEEK, WINDOW_SQL, rounded, weeks, weighted
from agora.registry import query
from agora.tables import WEIGHT_SQL

OPINION_SQL = f"{WEIGHT_SQL}, opinion AS (SELECT user_id, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean, {VAR_SQL} AS var FROM wobs GROUP BY 1, 2)"
PAIR_SQL = f"{OPINION_SQL}, pairs AS (SELECT a.user_id, a.issue AS i, b.issue AS j, a.mean AS x, b.mean AS y, a.var AS vx, b.var AS vy FROM opinion a JOIN opinion b ON a.user_id = b.user_id AND a.issue < b.issue WHERE a.mean IS NOT NULL AND b.mean IS NOT NULL)"
LINE_SQL = f"{WEIGHT_SQL}, {WINDOW_SQL}, line AS (SELECT window_id, user_id, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean, {VAR_SQL} AS var FROM wobs JOIN win ON t >= lo AND t <= hi GROUP BY 1, 2, 3)"


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.opinion(weighted(spark, sf_dir), ["user_id", "issue"]), "mean", "var")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.timeline(weighted(spark, sf_dir), weeks(spark, sf_dir), WEEK), "mean", "var")


SUMS_SQL = "sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy, count(*) AS n"


@query(f"""WITH {PAIR_SQL}, s AS (SELECT i, j, {SUMS_SQL} FROM (SELECT *, 1 / greatest((vx + vy) / 2, 0.01) AS w FROM pairs WHERE vx IS NOT NULL AND vy IS NOT NULL) GROUP BY 1, 2),
c AS (SELECT *, sxx - sx * sx / sw AS cxx, syy - sy * sy / sw AS cyy, sxy - sx * sy / sw AS cxy FROM s)
SELECT i, j, n, round(cxy / cxx, 6) + 0.0 AS slope, round((sy - cxy / cxx * sx) / sw, 6) + 0.0 AS intercept, round(cxy * cxy / (cxx * cyy), 6) + 0.0 AS r2 FROM c""")
def weighted_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = la.least_squares(la.issue_pairs(opinions(spark, sf_dir)), ["i", "j"])
    return rounded(rows, "slope", "intercept", "r2").drop("t")


@query(f"""WITH {PAIR_SQL}, s AS (SELECT i, j, {SUMS_SQL} FROM (SELECT *, exp(-(vx + vy)) AS w FROM pairs WHERE vx IS NOT NULL AND vy IS NOT NULL) GROUP BY 1, 2)
SELECT i, j, n, round((sxy - sx * sy / sw) / sqrt((sxx - sx * sx / sw) * (syy - sy * sy / sw)), 6) + 0.0 AS r FROM s""")
def weighted_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(la.weighted_pearson(la.issue_pairs(opinions(spark, sf_dir)), ["i", "j"]), "r")


@query(f"WITH {PAIR_SQL} SELECT i, j, count(*) AS n, round(avg(x * y), 6) + 0.0 AS product FROM pairs WHERE x <> 0 AND y <> 0 GROUP BY 1, 2")
def nonzero_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = la.issue_pairs(opinions(spark, sf_dir), without_zero=True)
    return rounded(rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") * F.col("y")).alias("product")), "product")


@query(f"WITH {LINE_SQL}, p AS (SELECT a.window_id, a.issue AS i, b.issue AS j, a.mean AS x, b.mean AS y FROM line a JOIN line b ON a.user_id = b.user_id AND a.window_id = b.window_id AND a.issue < b.issue) SELECT window_id, i, j, count(*) AS n, round(greatest(-1, least(1, corr(x, y))), 6) + 0.0 AS r FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def corr_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line(spark, sf_dir)
    a = rows.select("window_id", "user_id", F.col("issue").alias("i"), F.col("mean").alias("x"))
    b = rows.select("window_id", "user_id", F.col("issue").alias("j"), F.col("mean").alias("y"))
    return rounded(la.correlation_timeline(a.join(b, ["window_id", "user_id"]).where("i < j"), ["window_id", "i", "j"]), "r")


@query(f"WITH {LINE_SQL} SELECT window_id, issue, count(*) AS n, round(sum(exp(-var) * mean) / sum(exp(-var)), 6) + 0.0 AS mean FROM line WHERE var IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(la.window_means(line(spark, sf_dir), ["window_id", "issue"]), "mean")


@query(f"""WITH {OPINION_SQL}, g AS (SELECT i AS g, i * (2.0::DOUBLE / 24) - 1 AS x FROM range(25) r(i)),
d AS (SELECT issue, user_id, g, CASE WHEN var <= 1e-9 THEN CASE WHEN g = least(greatest(ceil((mean + 1) * 12.0 - 0.5), 0), 24) THEN 1.0::DOUBLE ELSE 0 END ELSE exp(-power(x - mean, 2) / (2 * var)) / sqrt(2 * pi() * var) END AS p FROM opinion, g WHERE mean IS NOT NULL AND var IS NOT NULL),
u AS (SELECT issue, g, p / sum(p) OVER (PARTITION BY issue, user_id) AS p FROM d), s AS (SELECT issue, g, sum(p) AS p FROM u GROUP BY 1, 2) SELECT issue, g, round(p / sum(p) OVER (PARTITION BY issue), 6) + 0.0 AS p FROM s""")
def gaussian_mixture_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(la.mixture_1d(opinions(spark, sf_dir), ["issue"]), "p")


@query(f"""WITH {PAIR_SQL}, g AS (SELECT i AS g, i * (2.0::DOUBLE / 24) - 1 AS v FROM range(25) r(i)),
d AS (SELECT i, j, user_id, a.g AS gx, b.g AS gy, exp(-power(a.v - x, 2) / (2 * vx)) / sqrt(2 * pi() * vx) * exp(-power(b.v - y, 2) / (2 * vy)) / sqrt(2 * pi() * vy) AS p FROM pairs, g a, g b WHERE vx > 1e-9 AND vy > 1e-9),
u AS (SELECT i, j, gx, gy, p / sum(p) OVER (PARTITION BY i, j, user_id) AS p FROM d), s AS (SELECT i, j, gx, gy, sum(p) AS p FROM u GROUP BY 1, 2, 3, 4) SELECT i, j, gx, gy, round(p / sum(p) OVER (PARTITION BY i, j), 6) + 0.0 AS p FROM s""")
def gaussian_mixture_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(la.mixture_2d(la.issue_pairs(opinions(spark, sf_dir)), ["i", "j"]), "p")


@query(f"""WITH {WEIGHT_SQL}, ab AS (SELECT user_id, issue, 1.0::DOUBLE + count(*) FILTER (value = 1) AS a, 1.0::DOUBLE + count(*) FILTER (value = -1) AS b FROM wobs GROUP BY 1, 2), g AS (SELECT i AS g, (i + 0.5::DOUBLE) / 25 AS x FROM range(25) r(i)),
l AS (SELECT issue, user_id, g, (a - 1) * ln(x) + (b - 1) * ln(1 - x) AS v FROM ab, g), e AS (SELECT issue, user_id, g, exp(v - max(v) OVER (PARTITION BY issue, user_id)) AS p FROM l), u AS (SELECT issue, g, p / sum(p) OVER (PARTITION BY issue, user_id) AS p FROM e), s AS (SELECT issue, g, sum(p) AS p FROM u GROUP BY 1, 2)
SELECT issue, g, round(p / sum(p) OVER (PARTITION BY issue), 6) + 0.0 AS p FROM s""")
def beta_mixture_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betas of counts: one more than a user's favor and against observations."""
    favor, against = (F.count(F.when(F.col("value") == k, 1)).cast("double") + 1 for k in (1, -1))
    rows = weighted(spark, sf_dir).groupBy("user_id", "issue").agg(favor.alias("alpha"), against.alias("beta"))
    return rounded(la.beta_mixture(rows, ["issue"]), "p")


@query(f"""WITH {WEIGHT_SQL}, s AS (SELECT user_id, issue, [avg(CASE WHEN value = -1 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN value = 1 THEN 1.0::DOUBLE ELSE 0 END)] AS p FROM wobs GROUP BY 1, 2)
SELECT x.issue AS i, y.issue AS j, a, b, round(avg(x.p[a + 1] * y.p[b + 1]), 6) AS p FROM s x JOIN s y ON x.user_id = y.user_id AND x.issue < y.issue, range(3) r(a), range(3) q(b) GROUP BY 1, 2, 3, 4""")
def mean_outer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = [F.avg(F.when(F.col("value") == k, 1.0).otherwise(0.0)).alias(n) for k, n in ((-1, "against"), (0, "neutral"), (1, "favor"))]
    rows = weighted(spark, sf_dir).groupBy("user_id", "issue").agg(*shares)
    return rounded(la.mean_products(rows, ["against", "neutral", "favor"]), "p")


BELIEF_SQL = f"{OPINION_SQL}, belief AS (SELECT user_id, issue, 0.5 * (coalesce(mean, 0) + 1) AS b FROM opinion)"


@query(f"WITH {BELIEF_SQL}, d AS (SELECT issue, abs(b - avg(b) OVER (PARTITION BY issue)) AS d FROM belief), p AS (SELECT issue, sum(d) / (2 * count(*)) AS p FROM d GROUP BY 1) SELECT round(sum(p), 6) AS polarization FROM p")
def symmetric_polarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(la.symmetric_polarization(la.beliefs(opinions(spark, sf_dir))), "polarization")


@query(f"""WITH {BELIEF_SQL}, part(part, issue) AS (VALUES (0, 1), (1, 2), (2, 1), (2, 2)), y AS (SELECT part, user_id, avg(b) AS y FROM belief JOIN part USING (issue) GROUP BY 1, 2),
s AS (SELECT part, row_number() OVER o AS i, sum(y) OVER (PARTITION BY part ORDER BY y, user_id ROWS UNBOUNDED PRECEDING) AS low, count(*) OVER (PARTITION BY part) AS n, sum(y) OVER (PARTITION BY part) AS tot FROM y WINDOW o AS (PARTITION BY part ORDER BY y, user_id))
SELECT CAST(part AS INTEGER) AS part, round(max((i * (tot - low) - (n - i) * low) / (4.0 * n * n)), 6) + 0.0 AS polarization FROM s GROUP BY 1""")
def asymmetric_polarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(la.asymmetric_polarization(la.beliefs(opinions(spark, sf_dir)), [0, 1, 2]), "polarization")


@query(f"""WITH {BELIEF_SQL}, c AS (SELECT issue, least(CAST(floor(b * 10) AS BIGINT), 9) AS bin, count(*) AS n FROM belief GROUP BY 1, 2), p AS (SELECT issue, bin, n / sum(n) OVER (PARTITION BY issue) AS p FROM c)
SELECT a.issue, round(sum(power(a.p, 2.6) * b.p * abs(a.bin - b.bin) / 10.0), 6) + 0.0 AS polarization FROM p a JOIN p b ON a.issue = b.issue GROUP BY 1""")
def esteban_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = la.belief_bins(la.beliefs(opinions(spark, sf_dir)), ["issue"])
    return rounded(la.esteban_ray(bins, ["issue"]), "polarization")


@query(f"WITH {LINE_SQL}, m AS (SELECT user_id, issue, round(max(mean) - min(mean), 6) AS range FROM line WHERE mean IS NOT NULL GROUP BY 1, 2) SELECT * FROM (SELECT user_id, issue, range, row_number() OVER (PARTITION BY issue ORDER BY range DESC, user_id) AS rank FROM m) WHERE rank <= 3")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.operators.relational import top_k

    moved = rounded(la.movement_range(line(spark, sf_dir)), "range").drop("windows")
    return top_k(moved, ["issue"], [F.col("range").desc(), F.col("user_id")], 3)


@query(f"WITH {LINE_SQL}, d AS (SELECT a.user_id, a.window_id AS w1, b.window_id AS w2, sqrt(sum(power(a.mean - b.mean, 2))) AS d FROM line a JOIN line b ON a.user_id = b.user_id AND a.issue = b.issue AND a.window_id < b.window_id GROUP BY 1, 2, 3) SELECT user_id, round(max(d), 6) AS distance FROM d GROUP BY 1")
def max_pairwise_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(la.farthest_windows(line(spark, sf_dir)), "distance")


@query(f"WITH {OPINION_SQL} SELECT issue, max(CASE WHEN hi = 1 THEN user_id END) AS most, max(CASE WHEN lo = 1 THEN user_id END) AS least, max(CASE WHEN ze = 1 THEN user_id END) AS nearest_zero FROM (SELECT issue, user_id, row_number() OVER (PARTITION BY issue ORDER BY mean DESC, user_id) AS hi, row_number() OVER (PARTITION BY issue ORDER BY mean, user_id) AS lo, row_number() OVER (PARTITION BY issue ORDER BY abs(mean), user_id) AS ze FROM opinion) GROUP BY 1")
def extreme_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mean")
    return opinions(spark, sf_dir).groupBy("issue").agg(
        F.max_by("user_id", F.struct(m, -F.col("user_id"))).alias("most"),
        F.min_by("user_id", F.struct(m, F.col("user_id"))).alias("least"),
        F.min_by("user_id", F.struct(F.abs(m), F.col("user_id"))).alias("nearest_zero"),
    )


def _normal_sql(x: str) -> str:
    """The normal distribution by Simpson's rule over its density."""
    return f"(0.5 + list_sum(list_transform(generate_series(0, 1000), lambda k: (CASE WHEN k = 0 OR k = 1000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(({x}) * k / 1000.0::DOUBLE, 2) / 2))) * ({x}) / 3000.0::DOUBLE / sqrt(2 * pi()))"


def _interval_sql(rows: str, keys: str, unit: str, terms: list[str], value: Callable[[list[str]], str]) -> str:
    """CTEs ending in `ci`: bias-corrected and accelerated intervals of a value of sums over the rows of a table."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    names, sums = [f"t{k}" for k in range(len(terms))], [f"s{k}" for k in range(len(terms))]
    halves = ", ".join(repr(8 * 0.5**k) for k in range(1, 50))
    z = NormalDist().inv_cdf(0.975)
    cut = [_normal_sql(f"b0 + (b0 + {e!r}) / (1 - skew * (b0 + {e!r}))") for e in (-z, z)]
    at = lambda c: f"(v[CAST(floor({c} * (len(v) - 1)) AS BIGINT) + 1] + ({c} * (len(v) - 1) - floor({c} * (len(v) - 1))) * (v[least(CAST(floor({c} * (len(v) - 1)) AS BIGINT) + 2, len(v))] - v[CAST(floor({c} * (len(v) - 1)) AS BIGINT) + 1]))"
    return f"""tt AS (SELECT {keys}, {unit} AS unit, {", ".join(f"{t} AS {x}" for t, x in zip(terms, names))} FROM {rows}),
ww AS (SELECT *, {value(sums)} AS est FROM (SELECT {keys}, count(*) AS n, {", ".join(f"sum({x}) AS {y}" for x, y in zip(names, sums))} FROM tt GROUP BY {keys})),
dd AS (SELECT {", ".join(f"a.{k}" for k in keys.split(", "))}, {value([f"(b.{y} - a.{x})" for x, y in zip(names, sums)])} - est AS d FROM tt a JOIN ww b ON {on}),
mm AS (SELECT {keys}, count(d) AS m, avg(d) AS mean, sum(d * d) AS d2, sum(d * d * d) AS d3 FROM dd GROUP BY {keys}),
kk AS (SELECT {keys}, coalesce(CASE WHEN d2 - m * mean * mean > 1e-24 THEN -(d3 - 3 * mean * d2 + 2 * m * mean * mean * mean) / (6 * power(greatest(d2 - m * mean * mean, 1e-24), 1.5)) END, 0.0) AS skew FROM mm),
pp AS (SELECT tt.*, k AS replicate, CAST({poisson_sql(uniform_sql(0, "k", "unit"))} AS DOUBLE) AS w FROM tt, generate_series(1, 200) g(k)),
rr AS (SELECT {keys}, {value(sums)} AS r FROM (SELECT {keys}, replicate, {", ".join(f"sum(w * {x}) AS {y}" for x, y in zip(names, sums))} FROM pp WHERE w > 0 GROUP BY {keys}, replicate)),
vv AS (SELECT {keys}, list_sort(list(r)) AS v FROM rr WHERE r IS NOT NULL GROUP BY {keys}),
jj AS (SELECT ww.*, skew, v, (len(list_filter(v, lambda r: round(r, 9) < round(est, 9))) + len(list_filter(v, lambda r: round(r, 9) = round(est, 9))) / 2.0::DOUBLE) / len(v) AS p FROM ww JOIN kk USING ({keys}) LEFT JOIN vv USING ({keys})),
zz AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN list_reduce([0.0::DOUBLE, {halves}], lambda x, s: x + s * (CASE WHEN {_normal_sql("x")} < p THEN 1 ELSE -1 END)) END AS b0 FROM jj),
cc AS (SELECT *, {cut[0]} AS c0, {cut[1]} AS c1 FROM zz),
ci AS (SELECT {keys}, n, est, {at("c0")} AS low, {at("c1")} AS high FROM cc)"""


_CORR = _interval_sql("pairs", "i, j", "user_id", ["1.0::DOUBLE", "x", "y", "x * x", "y * y", "x * y"], lambda t: f"({t[5]} * {t[0]} - {t[1]} * {t[2]}) / nullif(sqrt(greatest({t[3]} * {t[0]} - {t[1]} * {t[1]}, 0) * greatest({t[4]} * {t[0]} - {t[2]} * {t[2]}, 0)), 0)")


@query(f"WITH {PAIR_SQL}, {_CORR} SELECT i, j, n, round(est, 6) + 0.0 AS estimate, round(low, 5) + 0.0 AS low, round(high, 5) + 0.0 AS high FROM ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias-corrected intervals of the correlation of two issues."""
    rows = la.issue_pairs(opinions(spark, sf_dir)).withColumn("unit", F.col("user_id"))
    found = rounded(la.bootstrap(rows, ["i", "j"], ["unit"], la.CORRELATION), "estimate")
    return found.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("low", "high")})


_MEANS = _interval_sql("(SELECT * FROM line WHERE var IS NOT NULL)", "window_id, issue", "user_id", ["exp(-var)", "exp(-var) * mean"], lambda t: f"{t[1]} / nullif({t[0]}, 0)")


@query(f"WITH {LINE_SQL}, {_MEANS} SELECT window_id, issue, n, round(est, 6) + 0.0 AS estimate, round(low, 5) + 0.0 AS low, round(high, 5) + 0.0 AS high FROM ci WHERE n >= 2")
def window_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias-corrected intervals of the mean opinion of each window, weighted by e ** -var."""
    rows = line(spark, sf_dir).where("var is not null").withColumn("unit", F.col("user_id"))
    found = rounded(la.bootstrap(rows, ["window_id", "issue"], ["unit"], la.WEIGHTED_MEAN).where("n >= 2"), "estimate")
    return found.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("low", "high")})


#: Embeddings in order of id; each is compared with the one before.
DIST_SQL = """e AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
dist AS (SELECT vec_id, label, sqrt(list_sum(list_transform(generate_series(1, len(embedding)), lambda k: power(embedding[k]::DOUBLE - prev[k]::DOUBLE, 2)))) AS euclid,
 list_sum(list_transform(generate_series(1, len(embedding)), lambda k: embedding[k]::DOUBLE * prev[k]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(prev, lambda x: x::DOUBLE * x::DOUBLE)))) AS cosine FROM e WHERE prev IS NOT NULL)"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("prev", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("prev is not null")
    return rows.select("vec_id", "label", vec.euclid(F.col("embedding"), F.col("prev")).alias("euclid"), vec.cosine(F.col("embedding"), F.col("prev")).alias("cosine"))


@query(f"WITH {DIST_SQL} SELECT vec_id, label, round(euclid, 6) AS euclid, round(cosine, 6) + 0.0 AS cosine FROM dist")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances(spark, sf_dir), "euclid", "cosine")


@query("SELECT label, k - 1 AS dim, round(avg(embedding[k]::DOUBLE), 6) + 0.0 AS mean FROM embeddings, generate_series(1, 64) g(k) GROUP BY 1, 2")
def centroid_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rounded(rows.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("mean")), "mean")


@query("""WITH x AS (SELECT label, vec_id, k - 1 AS dim, embedding[k]::DOUBLE AS v FROM embeddings, generate_series(1, 64) g(k))
SELECT label, vec_id, dim, round(avg(v) OVER (PARTITION BY label, dim ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) + 0.0 AS before_mean, round(avg(v) OVER (PARTITION BY label, dim ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS after_mean FROM x""")
def before_after_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", F.posexplode("embedding").alias("dim", "v"))
    rows = means_around(rows, ["label", "dim"], ["vec_id"], "v")
    return rounded(rows.select("label", "vec_id", F.col("dim").cast("long").alias("dim"), F.col("before").alias("before_mean"), F.col("after").alias("after_mean")), "before_mean", "after_mean")


@query(f"WITH {DIST_SQL}, d AS (SELECT vec_id, euclid AS p, 1 - cosine AS o FROM dist) SELECT vec_id, round(1 / (1 + exp(o - p)), 6) AS nearer, round(1 / (1 + exp(-least((o + p) / 2.0 - 1, 100))), 6) AS beyond FROM d")
def between_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distances(spark, sf_dir).select("vec_id", F.col("euclid").alias("p"), (1 - F.col("cosine")).alias("o"))
    return rounded(rows.select("vec_id", vec.between(F.col("p"), F.col("o")).alias("nearer"), vec.away(F.col("p"), F.col("o"), F.lit(2.0)).alias("beyond")), "nearer", "beyond")


FIT_SQL = f"""{PAIR_SQL}, s AS (SELECT i, j, {SUMS_SQL} FROM (SELECT *, 1 / greatest((vx + vy) / 2, 0.01) AS w FROM pairs WHERE vx IS NOT NULL AND vy IS NOT NULL) GROUP BY 1, 2),
c AS (SELECT *, sxx - sx * sx / sw AS cxx, syy - sy * sy / sw AS cyy, sxy - sx * sy / sw AS cxy FROM s)"""


@query(f"""WITH {FIT_SQL}, t AS (SELECT i, j, n, sqrt(cxy * cxy / (cxx * cyy) * (n - 2) / (1 - cxy * cxy / (cxx * cyy))) AS t, n - 2 AS f FROM c),
h AS (SELECT i, j, n, t, f, k, CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM t, generate_series(0, 4000) g(k))
SELECT i, j, n, round(greatest(1 - 2 * sum(w * exp(lgamma((f + 1) / 2.0) - lgamma(f / 2.0)) / sqrt(f * pi()) * power(1 + power(t * k / 4000.0, 2) / f, -(f + 1) / 2.0)) * max(t) / 12000.0, 0), 5) + 0.0 AS p FROM h GROUP BY 1, 2, 3""")
def regression_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against Simpson's rule over the density."""
    rows = la.with_p_values(la.least_squares(la.issue_pairs(opinions(spark, sf_dir)), ["i", "j"]))
    return rows.select("i", "j", "n", (F.round("p", 5) + F.lit(0.0)).alias("p"))


@query(f"WITH {FIT_SQL} SELECT i, j, n, round(sx / sw, 6) + 0.0 AS mean_x, round(sy / sw, 6) + 0.0 AS mean_y, round(sqrt(cxx / sw), 6) AS std_x, round(sqrt(cyy / sw), 6) AS std_y, round(cxy / sqrt(cxx * cyy), 6) + 0.0 AS corr FROM c")
def weighted_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = la.weighted_description(la.issue_pairs(opinions(spark, sf_dir)), ["i", "j"])
    return rounded(rows, "mean_x", "mean_y", "std_x", "std_y", "corr")


BETA_SQL = f"{WEIGHT_SQL}, ab AS (SELECT user_id, issue, 1.0::DOUBLE + count(*) FILTER (value = 1) AS a, 1.0::DOUBLE + count(*) FILTER (value = -1) AS b FROM wobs GROUP BY 1, 2), g AS (SELECT i AS g, (i + 0.5::DOUBLE) / 25 AS x FROM range(25) r(i))"


@query(f"""WITH {BETA_SQL}, l AS (SELECT issue, user_id, g, (a - 1) * ln(x) + (b - 1) * ln(1 - x) AS v FROM ab, g), e AS (SELECT issue, user_id, g, exp(v - max(v) OVER (PARTITION BY issue, user_id)) AS p FROM l), u AS (SELECT issue, user_id, g, p / sum(p) OVER (PARTITION BY issue, user_id) AS p FROM e),
s AS (SELECT x.issue AS i, y.issue AS j, x.g AS gx, y.g AS gy, sum(x.p * y.p) AS p FROM u x JOIN u y ON x.user_id = y.user_id AND x.issue < y.issue GROUP BY 1, 2, 3, 4) SELECT i, j, gx, gy, round(p / sum(p) OVER (PARTITION BY i, j), 6) + 0.0 AS p FROM s""")
def beta_mixture_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    favor, against = (F.count(F.when(F.col("value") == k, 1)).cast("double") + 1 for k in (1, -1))
    rows = weighted(spark, sf_dir).groupBy("user_id", "issue").agg(favor.alias("a"), against.alias("b"))
    one = rows.select("user_id", F.col("issue").alias("i"), F.col("a").alias("ax"), F.col("b").alias("bx"))
    two = rows.select("user_id", F.col("issue").alias("j"), F.col("a").alias("ay"), F.col("b").alias("by"))
    return rounded(la.beta_mixture_2d(one.join(two, "user_id").where("i < j"), ["i", "j"]), "p")


@query(f"""WITH {BETA_SQL}, l AS (SELECT issue, user_id, g, x, (a - 1) * ln(x) + (b - 1) * ln(1 - x) AS v FROM ab, g), e AS (SELECT issue, user_id, g, x, exp(v - max(v) OVER (PARTITION BY issue, user_id)) AS p FROM l), u AS (SELECT issue, x, p / sum(p) OVER (PARTITION BY issue, user_id) AS p FROM e) SELECT issue, round(sum(p * x) / sum(p), 6) AS mean FROM u GROUP BY 1""")
def mixture_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    favor, against = (F.count(F.when(F.col("value") == k, 1)).cast("double") + 1 for k in (1, -1))
    rows = weighted(spark, sf_dir).groupBy("user_id", "issue").agg(favor.alias("alpha"), against.alias("beta"))
    return rounded(la.mixture_mean(la.beta_mixture(rows, ["issue"]), ["issue"], 0.0, 1.0, 25, inside=True), "mean")


@query(f"""WITH {WEIGHT_SQL}, o AS (SELECT issue, event_type AS community, w, value FROM wobs UNION ALL SELECT issue, 'all', w, value FROM wobs) SELECT community, issue, round(sum(w * value) / nullif(sum(w), 0), 6) + 0.0 AS mean, count(*) AS n FROM o GROUP BY 1, 2""")
def opinion_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = la.for_each(weighted(spark, sf_dir).withColumnRenamed("event_type", "community"), "community")
    return rounded(op.opinion(rows, ["community", "issue"]).drop("var"), "mean")
