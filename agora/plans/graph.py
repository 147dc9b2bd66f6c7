"""Graphs, inference, dynamics and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.operators import dynamics as dy
from agora.operators import graph as gr
from agora.operators import inference as inf
from agora.operators import topics as tp
from agora.plans.opinions import rounded
from agora.registry import query
from agora.functions.draws import uniform, uniform_sql
from agora.sources import store
from agora.tables import EDGE_SQL, OBS_SQL, PROFILE_SQL, edges, observations, profiles, read


@query(f"""WITH {EDGE_SQL}, b AS (SELECT src, dst, 'typed_' || type AS type, t AS unix_createtime FROM edge) SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, min(unix_createtime) AS first FROM b GROUP BY 1""")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    both = gr.graph(*[gr.typed_edges(rows.where(F.col("type") == k), "src", "dst", f"typed_{k}", "t", ["order_id", "line"]) for k in ("A", "N", "R")])
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.min("unix_createtime").alias("first"))


@query(f"WITH {EDGE_SQL} SELECT src AS node FROM edge UNION SELECT dst FROM edge UNION SELECT c_custkey FROM customer")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.nodes(edges(spark, sf_dir), read(spark, sf_dir, "customer").select("c_custkey"))


@query("""WITH m AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{12,}'))) AS word FROM conversations) SELECT conv_id AS src, word AS dst, count(*) AS n FROM m GROUP BY 1, 2""")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("mentions", F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{12,}"), F.lit(0)))
    out = gr.mention_edges(rows, "conv_id", "mentions", "mention", None, ["turn"], once=True)
    return out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id AS src, unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS dst, 'mention' AS type, turn FROM conversations""")
def every_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each mention, those that a turn repeats among them."""
    rows = read(spark, sf_dir, "conversations").withColumn("mentions", F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{12,}"), F.lit(0)))
    out = gr.mention_edges(rows, "conv_id", "mentions", "mention", None, ["turn"], once=False)
    return out.select("src", "dst", "type", F.get_json_object("attrs", "$.turn").cast("int").alias("turn"))


@query("""WITH c AS (SELECT conv_id * 100 + turn AS item, conv_id * 10 + turn % 3 AS author, CASE WHEN turn > 0 THEN conv_id * 100 + turn // 2 END AS parent FROM conversations), b AS (SELECT item, author FROM c WHERE parent IS NULL) SELECT r.author AS src, coalesce(b.author, -1) AS dst, r.item FROM c r LEFT JOIN b ON r.parent = b.item WHERE r.parent IS NOT NULL""")
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    rows = read(spark, sf_dir, "conversations").select((conv * 100 + turn).alias("item"), (conv * 10 + turn % 3).alias("author"), F.when(turn > 0, conv * 100 + F.floor(turn / 2)).alias("parent"))
    out = gr.reply_edges(rows, "author", "item", "parent", "comment_reply", None)
    return out.select("src", F.coalesce("dst", F.lit(-1)).alias("dst"), F.get_json_object("attrs", "$.item").cast("long").alias("item"))


@query(f"""WITH {EDGE_SQL}, e AS (SELECT src AS node, type FROM edge UNION ALL SELECT dst, type FROM edge), a AS (SELECT node, type FROM e UNION ALL SELECT node, 'all' FROM e), d AS (SELECT type, node, count(*) AS degree FROM a GROUP BY 1, 2), c AS (SELECT type, degree, count(*) AS n FROM d GROUP BY 1, 2), m AS (SELECT type, unnest(generate_series(0, max(degree))) AS degree FROM c GROUP BY 1)
SELECT type, degree, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (type, degree)""")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degree_histogram(edges(spark, sf_dir))


RING_SQL = f"""{EDGE_SQL}, b AS (SELECT DISTINCT src, dst FROM edge UNION SELECT DISTINCT dst, src FROM edge),
u AS (SELECT DISTINCT src AS u FROM edge WHERE src % 100 = 0), r1 AS (SELECT DISTINCT u, dst AS node FROM u JOIN b ON src = u WHERE dst <> u), r2 AS (SELECT DISTINCT u, dst AS node FROM r1 JOIN b ON src = node WHERE dst <> u AND (u, dst) NOT IN (SELECT u, node FROM r1)), r3 AS (SELECT DISTINCT u, dst AS node FROM r2 JOIN b ON src = node WHERE dst <> u AND (u, dst) NOT IN (SELECT u, node FROM r1) AND (u, dst) NOT IN (SELECT u, node FROM r2))"""


@query(f"WITH {RING_SQL} SELECT u AS \"user\", 1 AS ring, count(*) AS n FROM r1 GROUP BY 1 UNION ALL SELECT u, 2, count(*) FROM r2 GROUP BY 1 UNION ALL SELECT u, 3, count(*) FROM r3 GROUP BY 1")
def neighbor_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings over all edges around the users whose id is divisible by 100: rings of all users are pairs of nearly all."""
    rows = edges(spark, sf_dir)
    return gr.ring_sizes(rows, rows.where("src % 100 = 0").select("src").distinct())


@query(f"""WITH {OBS_SQL}, p AS (SELECT a.comment_id AS ask, b.comment_id AS item, b.raw, row_number() OVER (PARTITION BY a.comment_id ORDER BY b.t, b.comment_id) AS r, count(*) OVER (PARTITION BY a.comment_id) AS n FROM obs a JOIN obs b ON a.user_id = b.user_id AND b.t >= a.t - 604800 AND b.t <= a.t)
SELECT ask, count(*) AS n, round(avg(raw), 6) AS mean FROM p WHERE r > 1 AND r < n GROUP BY 1""")
def trailing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    content = obs.select("user_id", "t", F.col("comment_id").alias("item"), "raw")
    asks = obs.select("user_id", F.col("comment_id").alias("ask"), F.col("t").alias("at"))
    return rounded(gr.trailing_means(content, asks, ["user_id"], "t", "item", "raw", "ask", "at", 604_800), "mean")


NORMAL_SQL = f"{PROFILE_SQL}, cn AS (SELECT classifier_idx, true_value, pred_value, CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY classifier_idx, pred_value), 0) AS q, CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY classifier_idx, true_value), 0) AS p FROM profile)"
POST_SQL = f"{NORMAL_SQL}, {OBS_SQL}, wide AS (SELECT classifier_idx, pred_value AS value, max(CASE WHEN true_value = -1 THEN coalesce(q, 1.0/3) END) AS qa, max(CASE WHEN true_value = 0 THEN coalesce(q, 1.0/3) END) AS qn, max(CASE WHEN true_value = 1 THEN coalesce(q, 1.0/3) END) AS qf FROM cn GROUP BY 1, 2), post AS (SELECT * FROM obs JOIN wide USING (classifier_idx, value))"


@query(f"WITH {NORMAL_SQL} SELECT CAST(classifier_idx AS INTEGER) AS classifier_idx, CAST(true_value AS INTEGER) AS true_value, CAST(pred_value AS INTEGER) AS pred_value, round(p, 6) AS p, round(q, 6) AS q FROM cn")
def confusion_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = profiles(spark)
    rows = inf.row_normalized(profile).join(inf.column_normalized(profile).drop("n"), ["classifier_idx", "true_value", "pred_value"])
    return rounded(rows, "p", "q").drop("n")


@query(f"WITH {POST_SQL} SELECT user_id, issue, round(avg(qa), 6) AS p_against, round(avg(qn), 6) AS p_neutral, round(avg(qf), 6) AS p_favor FROM post GROUP BY 1, 2")
def categorical_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inf.categorical(inf.posterior(observations(spark, sf_dir), profiles(spark)), ["user_id", "issue"])
    return rounded(rows, "p_against", "p_neutral", "p_favor")


@query(f"WITH {POST_SQL} SELECT user_id, issue, count(*) AS n, round(avg(qf - qa), 6) + 0.0 AS mu, round(greatest(sum(qf + qa) - count(*) * power(avg(qf - qa), 2), 0), 5) + 0.0 AS s FROM post GROUP BY 1, 2")
def normal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inf.normal_statistics(inf.posterior(observations(spark, sf_dir), profiles(spark)), ["user_id", "issue"])
    return rounded(rows, "mu").withColumn("s", F.round("s", 5) + F.lit(0.0))


#: Halving an interval 80 times finds where the slope of the log density in log sigma is 0.
MAP_SQL = f"""{POST_SQL}, st AS (SELECT user_id, issue, count(*) AS n, avg(qf - qa) AS mu, greatest(sum(qf + qa) - count(*) * power(avg(qf - qa), 2), 0) AS s FROM post GROUP BY 1, 2),
bi AS (SELECT user_id, issue, n, mu, s, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS k FROM st UNION ALL SELECT user_id, issue, n, mu, s, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, -n - 1 + s * exp(-(lo + hi)) - ((lo + hi) / 2 - 0.1) / 0.04 > 0 AS up FROM bi WHERE k < 80))"""


@query(f"WITH RECURSIVE {MAP_SQL} SELECT user_id, issue, n, round(mu, 6) + 0.0 AS mu, round(exp((lo + hi) / 2), 5) AS sigma FROM bi WHERE k = 80")
def normal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inf.normal(inf.posterior(observations(spark, sf_dir), profiles(spark)), ["user_id", "issue"])
    return rounded(rows, "mu").withColumn("sigma", F.round("sigma", 5))


@query()
def beta_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.beta(inf.posterior(observations(spark, sf_dir), profiles(spark)), ["user_id", "issue"])


@query()
def hmm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.hidden_markov(observations(spark, sf_dir), profiles(spark), "issue")


@query()
def hmm_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.movement_index(inf.hidden_markov(observations(spark, sf_dir), profiles(spark), "event_type"), ["event_type"])


#: What each event's user has just seen: up to 20 events before it on its issue and day. d is how far the seen value lies above the user's.
SEEN_SQL = f"{OBS_SQL}, r AS (SELECT comment_id, issue, t // 86400 AS day, raw, row_number() OVER (PARTITION BY issue, t // 86400 ORDER BY t, comment_id) AS r FROM obs), pairs AS (SELECT a.comment_id AS a, b.comment_id AS b, b.raw - a.raw AS d FROM r a JOIN r b ON a.issue = b.issue AND a.day = b.day AND b.r BETWEEN a.r - 20 AND a.r - 1)"


def seen_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, raw, seen): each event with an array of what its user has just seen."""
    rows = observations(spark, sf_dir).select("comment_id", "issue", F.floor(F.col("t") / 86_400).alias("day"), "t", "raw")
    last = Window.partitionBy("issue", "day").orderBy("t", "comment_id").rowsBetween(-20, -1)
    return rows.select(F.col("comment_id").alias("a"), "raw", F.collect_list(F.struct("comment_id", "raw")).over(last).alias("seen"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seen_by(spark, sf_dir).select("a", "raw", F.explode("seen").alias("s"))
    return rows.select("a", F.col("s.comment_id").alias("b"), (F.col("s.raw") - F.col("raw")).alias("d"))


@query(f"WITH {SEEN_SQL}, w AS (SELECT a, b, CASE WHEN d = 0 THEN 100.0::DOUBLE ELSE least(power(abs(d), -2.0), 100.0) END AS weight FROM pairs) SELECT a, b, round(weight / sum(weight) OVER (PARTITION BY a), 6) AS p FROM w")
def sbc_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dy.choice_probabilities(seen(spark, sf_dir).withColumn("d", F.abs("d")), ["a"], "d", 2.0)
    return rounded(rows.select("a", "b", "p"), "p")


@query(f"WITH {SEEN_SQL} SELECT a, round(coalesce(avg(d) FILTER (abs(d) < 10), 0), 6) + 0.0 AS move FROM pairs GROUP BY 1")
def bounded_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dy.bounded_confidence(seen(spark, sf_dir), ["a"], "d", 10.0), "move")


MOVE_SQL = f"{SEEN_SQL}, own AS (SELECT a, avg(d) AS d, avg(abs(d)) AS far, count(*) AS n FROM pairs GROUP BY 1), x AS (SELECT a, raw, d, far, n FROM own JOIN r ON comment_id = a)"


@query(f"WITH {MOVE_SQL} SELECT a, round(raw + 0.3 * d, 8) + 0.0 AS degroot, round(0.4 * raw + 0.6 * (raw + d), 8) + 0.0 AS friedkin_johnsen, n FROM x")
def update_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = seen(spark, sf_dir).groupBy("a").agg(F.avg("d").alias("d"), F.count(F.lit(1)).alias("n"))
    rows = own.join(observations(spark, sf_dir).select(F.col("comment_id").alias("a"), "raw"), "a")
    moved, pulled = dy.degroot(F.col("raw"), F.lit(0.3), F.col("d")), dy.friedkin_johnsen(F.col("raw"), F.col("raw") + F.col("d"), F.lit(0.4))
    # Values of few decimals: six places would meet ties.
    return rows.select("a", (F.round(moved, 8) + F.lit(0.0)).alias("degroot"), (F.round(pulled, 8) + F.lit(0.0)).alias("friedkin_johnsen"), "n")


@query(f"WITH {MOVE_SQL} SELECT pairs.a, b, round(power(abs(pairs.d), -2.0) / (power(abs(pairs.d), -2.0) + (n - 1) * power(far, -2.0)), 6) AS p FROM pairs JOIN x USING (a) WHERE pairs.d <> 0")
def bernoulli_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seen(spark, sf_dir)
    own = rows.groupBy("a").agg(F.avg(F.abs("d")).alias("far"), F.count(F.lit(1)).alias("n"))
    found = rows.join(own, "a").where("d <> 0")
    return rounded(found.select("a", "b", dy.bernoulli_average(F.abs("d"), F.col("far"), F.col("n"), 2.0).alias("p")), "p")


@query(f"""WITH {SEEN_SQL}, n AS (SELECT a, b, d, abs(d) AS far FROM pairs UNION ALL SELECT DISTINCT a, -1, 0.0, 5.0 FROM pairs), w AS (SELECT a, b, d, CASE WHEN far = 0 THEN 100.0::DOUBLE ELSE least(power(far, -2.0), 100.0) END AS w FROM n), p AS (SELECT a, b, d, sum(w / tot) OVER (PARTITION BY a ORDER BY b ROWS UNBOUNDED PRECEDING) AS up FROM (SELECT *, sum(w) OVER (PARTITION BY a) AS tot FROM w)),
c AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY b) AS k FROM p WHERE up > {uniform_sql(21, 'a')}) SELECT comment_id AS a, coalesce(b, -1) AS chosen, round(coalesce(d, 0), 6) + 0.0 AS difference FROM obs LEFT JOIN (SELECT * FROM c WHERE k = 1) c ON a = comment_id""")
def null_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's user takes up of what they have seen, or nothing: -1 and a difference of 0."""
    rows = seen_by(spark, sf_dir)
    rows = rows.withColumn("near", F.transform("seen", lambda x: F.struct(x["comment_id"].alias("b"), (x["raw"] - F.col("raw")).alias("d"))))
    return rounded(dy.chosen_among(rows, ["a"], "near", "b", "d", uniform(21, "a"), 5.0, 2.0), "difference")


@query()
def simulate_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four platforms of 100 users and 100 steps: users' positions at every step."""
    return dy.platforms(spark, 4).where("kind = 'user'").select("replica", "user_id", F.col("time").alias("step"), "position")


@query()
def simulated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who answered whom on two simulated platforms."""
    return dy.interaction_edges(dy.platforms(spark, 2)).groupBy("replica", "type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query()
def simulated_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions of simulated users by windows of ten steps."""
    from agora.operators import opinions as op

    platform = store.saved(dy.platforms(spark, 2), "platform")
    obs = op.from_simulator(platform.where("kind = 'post'"), platform.where("kind = 'comment'"))
    rows = op.weighted(obs, profiles(spark))
    line = op.opinion(op.in_windows(rows, op.windows(spark, 0, 100, 10), 10), ["replica", "window_id", "user_id", "issue"])
    return rounded(line, "mean", "var")


@query()
def simulated_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarization and movement at each step of two simulated platforms."""
    return dy.evaluated(dy.platforms(spark, 2))


@query()
def choice_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponent that explains best which earlier turn each turn answers, by how far apart their lengths are."""
    from agora.operators import opinions as op

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") > 1, F.col("turn") - 1).alias("parent"), F.log(F.length("text") + 1.0).alias("x"))
    rows = op.reply_pairs(turns, "conv_id", "turn", "parent", "x")
    w, error = dy.fit_choice_weight(rows, ["conv_id", "turn"], "distance", "chosen")
    return spark.createDataFrame([(w, error)], "w double, error double")


@query()
def reply_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moves the hidden states of the two sides of each talk: they see all earlier turns, answer the last and write one of some length."""
    from agora.operators import replies

    turns = read(spark, sf_dir, "conversations")
    size = lambda c: F.log1p(F.length(c).cast("double"))
    wrote = F.array(size(F.col("text")) - 5, size(F.regexp_replace("text", "[^ ]", "")) - 3)
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", F.concat_ws("-", "conv_id", "role").alias("user"), wrote.alias("wrote")).withColumn("seen", F.collect_list("wrote").over(earlier))
    rows = rows.withColumn("answered", F.when(F.size("seen") > 0, F.size("seen") - 1))
    table = replies.segments(rows, "user", [F.col("turn")], "wrote", "seen", "answered", 2)
    model = replies.fit(table, 2, rank=1)
    values = {"attention": model.attention, "weight": model.weight, "weight_error": model.error, "noise": model.noise, **{f"covariance_{i}{j}": float(model.covariance[i, j]) for i in range(2) for j in range(i + 1)}}
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "parameter string, value double")


@query()
def topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return tp.fit(rows, 10).apply(rows).select("vec_id", "label", "topic", "distance")


@query()
def sampled_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior of each user's opinion on each issue, by chains of draws."""
    from agora.operators import sampling

    return sampling.sampled_opinions(observations(spark, sf_dir), profiles(spark), ["user_id", "issue"])


@query()
def smooth_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth opinion behind each event, given all of its user's on the issue."""
    from agora.operators import smooth

    return smooth.trajectories(observations(spark, sf_dir), profiles(spark), ["user_id", "issue"], ["t", "comment_id"])


@query()
def density_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by density of reduced embeddings, of at least a hundredth of all."""
    rows = read(spark, sf_dir, "embeddings")
    return tp.density_topics(rows, max(5, rows.count() // 100))


@query()
def topic_model_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted on the even labels, its topics merged to five, applied to the odd ones."""
    rows = read(spark, sf_dir, "embeddings")
    model = tp.fit(rows.where("label % 2 = 0"), 10).merged(5)
    return model.apply(rows.where("label % 2 = 1")).select("vec_id", "label", "topic", "distance")


@query()
def topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges of ten topics down to one, nearest first."""
    tree = tp.fit(read(spark, sf_dir, "embeddings"), 10, hierarchical=True).tree()
    return spark.createDataFrame([(i, a, b, d) for i, (a, b, d) in enumerate(tree)], "step int, stays int, goes int, distance double")


@query()
def topics_within_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return tp.within_topics(rows, tp.fit(rows, 4, share=1.0), 3, share=1.0).select("vec_id", "label", "topic", "subtopic")


@query("""WITH c AS (SELECT lang AS topic, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2), z AS (SELECT topic, sum(n) AS size FROM c GROUP BY 1), m AS (SELECT avg(size) AS mean FROM z), s AS (SELECT topic, word, n, n / size * ln(1 + mean / sum(n) OVER (PARTITION BY word)) AS score FROM c JOIN z USING (topic), m)
SELECT topic, rank, word, n, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, word) AS rank FROM s) WHERE rank <= 10""")
def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), "text")
    return rounded(tp.topic_words(docs, "topic", F.split("text", " ")), "score")
