"""Queries over training steps, rollouts, embeddings, budgets and the tabular synthesis."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as text_functions
from marginalia.operators import accounting, aim, classify, marginals, mauve, private_training, rollouts, sampling
from marginalia.operators.encoding import Categorical
from marginalia.operators.ingest import domain_options
from marginalia.plans.catalogue import Catalogue, table
from marginalia.plans.feature_queries import real_features
from marginalia.session import bounded_rows

CATALOGUE = Catalogue()
query = CATALOGUE.query

_STEPS = "(SELECT event_id // 64 AS step, value AS reward, event_id FROM events)"


def steps(spark, d) -> DataFrame:
    """Events as rewards, 64 to a batch."""
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 64).alias("step"), F.col("value").alias("reward"), "event_id")


@query("A16_batch_rewards", f"SELECT step, avg(reward) AS mean, stddev_samp(reward) AS std FROM {_STEPS} GROUP BY 1")
def a16(spark, d):
    """Mean and sample deviation of each batch."""
    return rollouts.batch_rewards(steps(spark, d), "step", "reward")


_TRAILING = f"b AS (SELECT step, avg(reward) AS mean, stddev_samp(reward) AS std FROM {_STEPS} GROUP BY 1), t AS (SELECT *, avg(mean) OVER w AS mean_trailing, avg(std) OVER w AS std_trailing FROM b WINDOW w AS (ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"


@query("W01_trailing_means", f"WITH {_TRAILING} SELECT * FROM t")
def w01(spark, d):
    """Means of the last ten batches."""
    return rollouts.trailing(rollouts.batch_rewards(steps(spark, d), "step", "reward"), "step")


@query("W09_standardised_rewards", f"WITH {_TRAILING} SELECT s.event_id, s.step, s.reward, (reward - mean_trailing) / (std_trailing + 1e-8) AS scaled FROM {_STEPS} s JOIN t USING (step)")
def w09(spark, d):
    """Rewards over trailing mean and deviation."""
    return rollouts.standardised(steps(spark, d), "step", "reward").select("event_id", "step", "reward", "scaled")


@query("W07_best_so_far", f"WITH b AS (SELECT step, avg(reward) AS mean, stddev_samp(reward) AS std FROM {_STEPS} GROUP BY 1) SELECT *, max(mean) OVER (ORDER BY step) AS best FROM b")
def w07(spark, d):
    """The best batch so far."""
    return rollouts.best_so_far(rollouts.batch_rewards(steps(spark, d), "step", "reward"), "step")


@query("W08_linear_decay", f"SELECT DISTINCT step, 1 + (0.1 - 1) * least(1, step / 100.0e0) AS coefficient FROM {_STEPS}")
def w08(spark, d):
    """A coefficient that falls linearly."""
    return steps(spark, d).select("step").distinct().select("step", rollouts.linear_decay(F.col("step"), 1.0, 0.1, 100).alias("coefficient"))


@query("W03_tumbling_steps", f"SELECT floor((step - 1) / 5)::BIGINT AS \"group\", sum(reward) AS reward FROM {_STEPS} GROUP BY 1")
def w03(spark, d):
    """Sums over groups of five steps."""
    return rollouts.tumbling(steps(spark, d), "step", 5, reward="reward")


@query("A13_loss_and_perplexity", "SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS loss, exp(sum(l_discount * l_quantity) / sum(l_quantity)) AS perplexity FROM lineitem")
def a13(spark, d):
    """Token-weighted loss and perplexity."""
    return rollouts.weighted_loss(table(spark, d, "lineitem"), "l_discount", "l_quantity")


_SEQUENCES = "(SELECT l_orderkey, list(l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, list(CASE WHEN l_linenumber = 1 THEN -100 ELSE l_linenumber % 2 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS y FROM lineitem GROUP BY 1)"


def sequences(spark, d) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("z"))
    return rows.select("l_orderkey", F.transform("z", lambda z: z["l_linenumber"] % 3).alias("p"), F.transform("z", lambda z: F.when(z["l_linenumber"] == 1, -100).otherwise(z["l_linenumber"] % 2)).alias("y"))


@query("A14_next_token_accuracy", f"WITH e AS (SELECT p[i] AS p, y[i + 1] AS y FROM {_SEQUENCES} s, LATERAL (SELECT unnest(range(1, len(p))) AS i)) SELECT count(*) FILTER (p = y AND y <> -100) * 1e0 / count(*) FILTER (y <> -100) AS accuracy FROM e")
def a14(spark, d):
    """Predictions that meet the label one place later."""
    return rollouts.next_token_accuracy(sequences(spark, d), "p", "y")


@query("W04_shifted_hits", f"SELECT l_orderkey, len(list_filter(range(1, len(p)), lambda i: p[i] = y[i + 1] AND y[i + 1] <> -100)) AS hits FROM {_SEQUENCES}")
def w04(spark, d):
    """Hits after a shift by one, by row."""
    return sequences(spark, d).select("l_orderkey", rollouts.next_token_hits(F.col("p"), F.col("y")).cast("bigint").alias("hits"))


_ROLLS = "e AS (SELECT vec_id, label::DOUBLE AS score, least(16, label + 4) AS n, embedding AS v FROM embeddings), l AS (SELECT n, score, list_sum(list_transform(v[1:n], lambda x: x::DOUBLE)) AS kl, -list_sum(list_transform(v[17:16 + n], lambda x: x::DOUBLE)) / n AS h FROM e), t AS (SELECT unnest(v[33:32 + n])::DOUBLE AS a, unnest(v[49:48 + n])::DOUBLE AS r FROM e)"


@query("A17_rollout_statistics", f"WITH {_ROLLS} SELECT avg(kl) AS kl, avg(h) AS entropy, avg(score) AS score_mean, stddev_samp(score) AS score_std, avg(n) AS length_mean, stddev_samp(n) AS length_std, 1 - (SELECT var_pop(r - a) / var_pop(r) FROM t) AS explained_variance FROM l")
def a17(spark, d):
    """Statistics of a batch of rollouts."""
    e = table(spark, d, "embeddings")
    first = lambda n, s: F.transform(F.slice("embedding", s, n), lambda x: x.cast("double"))
    mask = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (i <= F.col("label") + 4).cast("double"))
    return rollouts.rollout_statistics(e.select(first(16, 1).alias("kl"), first(16, 17).alias("logprobs"), first(16, 33).alias("values"), first(16, 49).alias("returns"), mask.alias("mask"), F.col("label").cast("double").alias("score")))


@query("X13_clipped_losses", "SELECT l_orderkey, l_linenumber, greatest(-(l_discount - 0.05) * (1 + l_tax * 5), -(l_discount - 0.05) * greatest(least(1 + l_tax * 5, 1.2e0), 0.8e0)) AS policy, 0.5 * greatest((l_tax - l_discount) ** 2, (greatest(least(l_tax, 0.04e0 + 0.02e0), 0.04e0 - 0.02e0) - l_discount) ** 2) AS value FROM lineitem")
def x13(spark, d):
    """Clipped policy and value losses."""
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rollouts.ppo_loss(1 + c("l_tax") * 5, c("l_discount") - 0.05).alias("policy"), rollouts.value_loss(c("l_tax"), F.lit(0.04), c("l_discount"), 0.02).alias("value"))


@query("X13_best_of_prompts", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_of(spark, d):
    """The best response of each prompt."""
    return rollouts.best_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query("F26_log_sum_exp", "SELECT max(value) + ln(sum(exp(value - (SELECT max(value) FROM events)))) AS log_sum_exp FROM events")
def f26(spark, d):
    """log of a sum of exponentials."""
    return rollouts.log_sum_exp(table(spark, d, "events"), "value")


@query("O02_multi_key_sort", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY 1, 2, 3")
def o02(spark, d):
    """Rows by several keys."""
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", "o_orderdate", "o_orderkey")


@query("A23_quarter_epochs", "SELECT DISTINCT o_orderpriority, least(x, n - 1)::INT AS step FROM (SELECT o_orderpriority, n, unnest([floor(n * 0.25e0), floor(n * 0.5e0), floor(n * 0.75e0), n - 1]) AS x FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1))")
def a23(spark, d):
    """Distinct checkpoint steps at the quarters of each group."""
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    points = F.array_distinct(F.array(*[F.least(F.floor(F.col("n") * s), F.col("n") - 1).cast("int") for s in (0.25, 0.5, 0.75, 1.0)]))
    return n.select("o_orderpriority", F.explode(points).alias("step"))


# embeddings


@query("E07_normalised_rows", "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l2, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS l1 FROM embeddings) SELECT vec_id, round(embedding[1] / l2, 5) AS first, round(embedding[-1] / l2, 5) AS last, round(embedding[1] / l1, 6) AS first_l1 FROM n")
def e07(spark, d):
    """Entries of rows of length 1, in both norms."""
    unit = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    l2, l1 = mauve.normalised(unit, "v"), mauve.normalised(unit, "v", "l1")
    return unit.select("vec_id", F.round(l2[0], 5).alias("first"), F.round(F.element_at(l2, -1), 5).alias("last"), F.round(l1[0], 6).alias("first_l1"))


def label_bins(spark, d) -> DataFrame:
    """Labels as bins: even vectors are real, odd ones synthetic."""
    return table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "p").otherwise("q").alias("side"), F.col("label").alias("bin"))


_HIST = "h AS (SELECT label::INT AS bin, count(*) FILTER (vec_id % 2 = 0) * 1e0 / (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS p, count(*) FILTER (vec_id % 2 <> 0) * 1e0 / (SELECT count(*) FROM embeddings WHERE vec_id % 2 <> 0) AS q FROM embeddings GROUP BY 1)"
_CURVE = f"{_HIST}, g AS (SELECT i::INT AS i, 1e-6 + (1 - 2e-6) * i / 24 AS w FROM (SELECT unnest(range(25)) AS i)), m AS (SELECT i, p, q, w * p + (1 - w) * q AS r FROM h, g), c AS (SELECT i, exp(-5 * sum(CASE WHEN q = 0 THEN 0 ELSE q * ln(q / r) END)) AS x, exp(-5 * sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p / r) END)) AS y FROM m GROUP BY 1 UNION ALL SELECT -1, 0, 1 UNION ALL SELECT 25, 1, 0)"


@query("A06_cluster_histograms", f"WITH {_HIST} SELECT * FROM h")
def a06(spark, d):
    """Shares of bins on both sides."""
    return mauve.histograms(label_bins(spark, d))


@query("E10_divergence_curve", f"WITH {_CURVE} SELECT * FROM c")
def e10(spark, d):
    """The curve between two histograms."""
    return mauve.divergence_curve(mauve.histograms(label_bins(spark, d)))


@query("W05_curve_area", f"WITH {_CURVE} SELECT sum((x - lx) * (y + ly) / 2) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY x, y DESC) AS lx, lag(y) OVER (ORDER BY x, y DESC) AS ly FROM c)")
def w05(spark, d):
    """Trapezoid area under the curve."""
    return mauve.area(mauve.divergence_curve(mauve.histograms(label_bins(spark, d))))


@query("E11_mauve_of_bins", f"""WITH {_CURVE}, a AS (SELECT sum((x - lx) * (y + ly) / 2) AS a FROM (SELECT x, y, lag(x) OVER (ORDER BY x, y DESC) AS lx, lag(y) OVER (ORDER BY x, y DESC) AS ly FROM c)),
b AS (SELECT sum((y - ly) * (x + lx) / 2) AS b FROM (SELECT x, y, lag(x) OVER (ORDER BY y, x DESC) AS lx, lag(y) OVER (ORDER BY y, x DESC) AS ly FROM c)),
f AS (SELECT 2 * sum(CASE WHEN p = 0 AND q = 0 THEN 0 WHEN p = 0 THEN q / 4 WHEN q = 0 THEN p / 4 WHEN abs(p - q) > 1e-8 THEN (p + q) / 4 + p * q * (ln(q) - ln(p)) / (2 * (p - q)) ELSE 0 END) AS f FROM h)
SELECT (a + b) / 2 AS mauve, f AS frontier_integral FROM a, b, f""")
def e11(spark, d):
    """MAUVE and frontier integral, given bins."""
    return mauve.score(mauve.histograms(label_bins(spark, d)))


@query("E06_mauve")
def e06(spark, d):
    """MAUVE of even against odd embeddings, with PCA and k-means."""
    e = table(spark, d, "embeddings")
    return mauve.mauve(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 <> 0"))


@query("W02_explained_components", "WITH s AS (SELECT label AS i, count(*) * 1e0 / (SELECT count(*) FROM embeddings) AS share FROM embeddings GROUP BY 1), c AS (SELECT i, sum(share) OVER (ORDER BY i) AS total FROM s) SELECT min(i) FILTER (total >= 0.9) AS first FROM c")
def w02(spark, d):
    """First position at which a running sum reaches a threshold."""
    e = table(spark, d, "embeddings")
    counts = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.withColumn("all", F.sum("n").over(W.partitionBy())).withColumn("sum", F.sum("n").over(W.orderBy("label")))
    return total.agg(F.min(F.when(F.col("sum") / F.col("all") >= 0.9, F.col("label"))).alias("first"))


# classification


@query("A11_classifier_scores", """WITH t AS (SELECT CASE quality WHEN 5 THEN 4 ELSE quality END AS l, CASE WHEN flagged = 1 THEN 1 ELSE quality END AS p FROM domain_labels),
c AS (SELECT l AS c FROM t UNION SELECT p FROM t), s AS (SELECT c, (SELECT count(*) FROM t WHERE l = c) AS a, (SELECT count(*) FROM t WHERE p = c) AS s, (SELECT count(*) FROM t WHERE p = c AND l = c) AS h FROM c)
SELECT sum(h) * 1e0 / sum(a) AS accuracy, avg(CASE WHEN s > 0 THEN h * 1e0 / s ELSE 0 END) AS precision, avg(CASE WHEN a > 0 THEN h * 1e0 / a ELSE 0 END) AS recall, avg(CASE WHEN h > 0 THEN 2e0 * h / (s + a) ELSE 0 END) AS f1 FROM s""")
def a11(spark, d):
    """Accuracy and plain means of precision, recall and F1 over classes."""
    rows = table(spark, d, "domain_labels").select(F.when(F.col("quality") == 5, 4).otherwise(F.col("quality")).alias("label"), F.when(F.col("flagged") == 1, 1).otherwise(F.col("quality")).alias("prediction"))
    return classify.scores(rows)


@query("E13_text_classifier")
def e13(spark, d):
    """A classifier of languages, trained on nine tenths and scored on the rest."""
    rows = table(spark, d, "documents").filter("lang is not null and lang <> 'und' and text is not null").select("doc_id", "lang", "text")
    split = sampling.stratified_split(rows, "doc_id", "lang", 0.1)
    model = classify.classifier("text", "lang").fit(split.filter("split = 'train'"))
    return classify.scores(classify.predict(model, split.filter("split = 'validation'")), "lang")


# budgets and mechanisms


@query("M17_noise_columns", "SELECT p_partkey, sqrt(0.5 / p_size) AS sigma, sqrt(8 * p_size) AS eps, sqrt(1e0 / p_size) AS gdp, 1 / ((p_size + 1) * ln(p_size + 1)) AS delta FROM part")
def m17(spark, d):
    """Budgets as columns."""
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", accounting.gaussian_sigma(size).alias("sigma"), accounting.exponential_eps(size).alias("eps"), accounting.gdp_sigma(size).alias("gdp"), accounting.delta_rule(size + 1).alias("delta"))


@query("M16_budget_conversions")
def m16(spark, d):
    """Conversions between zCDP, Renyi and numerical budgets of a known configuration."""
    n, q, t, delta = 28_846, 2048 / 28_846, 1120, 3.38e-6
    second = accounting.Stage(4.3, q, t)
    s1 = accounting.first_stage_sigma(4.0, delta, second)
    rows = [("delta_rule", accounting.delta_rule(n)), ("zcdp_rho", accounting.zcdp_rho(4.0, delta)), ("zcdp_eps", accounting.zcdp_eps(0.18, delta)), ("first_sigma", s1), ("first_rho", 1 / (2 * s1 * s1)), ("second_eps", accounting.renyi_epsilon([second], delta)), ("second_eps_numeric", accounting.loss_epsilon([second], delta)), ("training_sigma", accounting.training_sigma(4.0, delta, q, t))]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "quantity string, value double")


@query("M24_scheme_grid")
def m24(spark, d):
    """Two-stage schemes that meet a budget."""
    return accounting.scheme_grid(spark, 28_846, 4.0, 3.38e-6, [1.0, 2.0], [(1024, 200)], [(2048, 400), (2048, 800)])


_MARGINALS = "c AS (SELECT 's' AS clique, o_orderstatus AS cell, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'p', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 's,p', o_orderstatus || ',' || o_orderpriority, count(*) FROM orders GROUP BY 2)"
_UNIFORM = "((('0x' || substr(md5(concat_ws('|', clique || ',' || cell{more}, '1')), 1, 12))::BIGINT + 0.5e0) / 281474976710656)"


@query("M01_noisy_marginals", f"WITH {_MARGINALS}, d AS (SELECT *, 2 * sqrt(6e0) / CASE clique WHEN 's,p' THEN 2 ELSE 1 END AS stddev FROM c) SELECT clique, cell, n, stddev, round(n + stddev * sqrt(-2 * ln({_UNIFORM.format(more='')})) * cos(2 * pi() * {_UNIFORM.format(more=", 'v'")}), 4) AS noisy FROM d")
def m01(spark, d):
    """Marginals under the Gaussian mechanism, with keyed noise."""
    counts = marginals.marginal_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")), [("s",), ("p",), ("s", "p")])
    noisy = marginals.measure(counts, 2.0, {"s": 1.0, "p": 1.0, "s,p": 2.0}, seed=1)
    return noisy.select("clique", F.array_join("cell", ",").alias("cell"), "n", "stddev", F.round("noisy", 4).alias("noisy"))


@query("M03_rare_cells", "SELECT p_brand AS brand, count(*) AS n, count(*) < 3 * 35e0 AS rare FROM part GROUP BY 1")
def m03(spark, d):
    """Cells below three standard deviations."""
    counts = marginals.marginal_counts(table(spark, d, "part").select(F.col("p_brand").alias("brand")), [("brand",)])
    rare = marginals.rare_cells(counts.withColumn("noisy", F.col("n").cast("double")).withColumn("stddev", F.lit(35.0)))
    return rare.select(F.element_at("cell", 1).alias("brand"), "n", "rare")


@query("M02_exponential_choice", "WITH s AS (SELECT o_orderpriority, count(*)::DOUBLE AS score FROM orders GROUP BY 1) SELECT arg_max(o_orderpriority, g) AS o_orderpriority, arg_max(score, g) AS score FROM (SELECT *, 0.5 * score - ln(-ln((('0x' || substr(md5(concat_ws('|', o_orderpriority, '3')), 1, 12))::BIGINT + 0.5e0) / 281474976710656)) AS g FROM s)")
def m02(spark, d):
    """A choice by the exponential mechanism, with keyed noise."""
    scores = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return marginals.exponential_choice(scores, "o_orderpriority", "score", 1.0, 1.0, seed=3)


_PAIRED = "s AS (SELECT feature_name AS f, count(*) AS n FROM feature_domain GROUP BY 1), w AS (SELECT x.f AS a, y.f AS b, (x.n * y.n)::DOUBLE AS weight FROM s x, s y WHERE x.f < y.f), q AS (SELECT f AS a, NULL AS b, f AS clique FROM s UNION ALL SELECT a, b, a || ',' || b FROM w)"


@query("M07_workload_weights", f"WITH {_PAIRED} SELECT clique, sum(weight * ((q.a IN (w.a, w.b))::INT + coalesce(q.b IN (w.a, w.b), false)::INT)) AS weight FROM q, w GROUP BY 1")
def m07(spark, d):
    """Weights of the downward closure of all pairs of features, a pair weighted by its cells."""
    by = table(spark, d, "feature_domain").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.feature_name: r.n for r in sorted(bounded_rows(by, 1000, "features"))}
    weights = marginals.workload_weights({(a, b): float(sizes[a] * sizes[b]) for a, b in combinations(sizes, 2)})
    return spark.createDataFrame([(",".join(q), float(w)) for q, w in weights.items()], "clique string, weight double")


@query("M27_clipped_gradients", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0.25 AS clipped, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings")
def m27(spark, d):
    """Gradients scaled to a norm."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("g"))
    norm = private_training.gradient_norm(F.col("g"))
    return e.select("vec_id", (private_training.gradient_norm(private_training.clipped(F.col("g"), 0.5)) < norm - 1e-9).alias("clipped"), norm.alias("norm"))


@query("M28_private_training")
def m28(spark, d):
    """Private softmax training on embeddings: the log of its steps."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding"), "label")
    _, log = private_training.train(e, "vec_id", "embedding", "label", 64, 10, 0.2, 5, 1.0, noise=aim.SeededNoise(0), seed=0)
    return spark.createDataFrame(log, "step int, examples int, loss double")


@query("M15_tabular_synthesis")
def m15(spark, d):
    """Synthetic records of the eight features under a budget: encode, measure, adapt, sample, decode. A model of 1 MB, the quick size."""
    domains = {c: Categorical(tuple(v)) for c, v in domain_options(table(spark, d, "feature_domain")).items()}
    return aim.synthesize(real_features(spark, d).drop("record_id"), domains, rho=0.18, noise=aim.SeededNoise(7), options=aim.Options(iterations=100, model_megabytes=1.0))


@query("K12_scheme_names", "SELECT o_orderpriority, 'schemes_aim-dpsgd_n' || count(*) || '_eps4_delta3.38e-06.csv' AS name FROM orders GROUP BY 1")
def k12(spark, d):
    """Names of the scheme tables of groups of rows."""
    from marginalia.sources.files import scheme_file

    by = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(r.o_orderpriority, scheme_file(r.n, 4.0, 3.38e-6, "aim-dpsgd")) for r in bounded_rows(by, 1000, "groups")], "o_orderpriority string, name string")


@query("X17_training_plan", "SELECT o_orderpriority, floor(20 / (64e0 / count(*)))::BIGINT AS steps, greatest(1, count(*) // (4 * 2)) AS accumulation FROM orders GROUP BY 1")
def x17(spark, d):
    """Steps and gradient accumulation of a run on each group."""
    by = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(r.o_orderpriority, accounting.training_steps(r.n, 64, 20), accounting.accumulation(r.n, 4, 2)) for r in bounded_rows(by, 1000, "groups")], "o_orderpriority string, steps long, accumulation long")


@query("F28_map_with_default", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END::INT AS code FROM events")
def f28(spark, d):
    """A lookup with a default."""
    codes = F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2))
    return table(spark, d, "events").select("event_id", F.coalesce(F.element_at(codes, F.col("event_type")), F.lit(0)).alias("code"))


@query("F10_name_groups", "SELECT p_partkey, regexp_extract(p_brand, '^(\\w+)#(\\d+)$', 1) AS family, regexp_extract(p_brand, '^(\\w+)#(\\d+)$', 2) AS number FROM part")
def f10(spark, d):
    """Groups of a pattern."""
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"^(\w+)#(\d+)$", 1).alias("family"), F.regexp_extract("p_brand", r"^(\w+)#(\d+)$", 2).alias("number"))


@query("F19_spaced_names", "SELECT DISTINCT feature_name, replace(feature_name, '_', ' ') AS spaced FROM feature_domain")
def f19(spark, d):
    """Field names with spaces."""
    return table(spark, d, "feature_domain").select("feature_name", text_functions.spaced(F.col("feature_name")).alias("spaced")).distinct()
