"""Queries of the smaller operators: projections, grids, alignments, list functions, model checks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marginalia.functions import services, text
from marginalia.operators import accounting, aim, divergence, encoding, graphical, marginals, mauve, private_training, rollouts
from marginalia.operators.ingest import domain_options
from marginalia.plans.catalogue import Catalogue, table
from marginalia.plans.feature_queries import FEATURES, REAL, even_odd, real_features
from marginalia.session import bounded_rows
from marginalia.sources import files
from marginalia.sources.registry import named_in

CATALOGUE = Catalogue()
query = CATALOGUE.query


# projections and filters


@query("P01_keep_columns", "SELECT doc_id, text FROM documents")
def p01(spark, d):
    """Chosen columns only; the others are not read."""
    return table(spark, d, "documents").select("doc_id", "text")


@query("P03_rename_many", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def p03(spark, d):
    """Several columns renamed."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "status"})


@query("P04_computed_name", "SELECT pair_id, length(instruction)::INT AS inferred_length FROM (SELECT DISTINCT pair_id, instruction FROM instruct_pairs)")
def p04(spark, d):
    """A column whose name is computed."""
    name = "length"
    return table(spark, d, "instruct_pairs").dropDuplicates(["pair_id"]).select("pair_id", F.length("instruction").alias(f"inferred_{name}"))


@query("P08_null_to_empty", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p08(spark, d):
    """Missing texts as empty ones."""
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("P09_null_predicate", "SELECT doc_id, text IS NULL AS missing FROM documents")
def p09(spark, d):
    """Whether a value is missing."""
    return table(spark, d, "documents").select("doc_id", F.col("text").isNull().alias("missing"))


@query("P22_apply_encodings", "SELECT CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END::INT AS o_orderstatus, o_orderkey FROM orders")
def p22(spark, d):
    """Encodings of some columns, the others passed through."""
    return encoding.encode(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), {"o_orderstatus": encoding.categorical(encoding.Categorical(("F", "O", "P")))}, drop_others=False)


@query("P24_ordered_batches", "SELECT vec_id // 64 AS batch, count(*) AS rows FROM embeddings GROUP BY 1")
def p24(spark, d):
    """Batches in the order of a gapless key."""
    return table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("batch")).agg(F.count(F.lit(1)).alias("rows"))


_GRID = "(SELECT a.n_nationkey AS e1, b.n_nationkey AS e FROM nation a, nation b)"


@query("P26_grid_filter", f"SELECT e1, e FROM {_GRID} WHERE e1 < e")
def p26(spark, d):
    """Pairs of a parameter grid below each other."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("e1")).join(n.select(F.col("n_nationkey").alias("e")), F.col("e1") < F.col("e"))


@query("P27_tolerance_filter", "SELECT p_partkey, p_retailprice FROM part WHERE abs(p_retailprice - 901) < 0.05")
def p27(spark, d):
    """Results within a tolerance."""
    return table(spark, d, "part").select("p_partkey", "p_retailprice").filter(F.abs(F.col("p_retailprice") - 901) < 0.05)


@query("J03_parameter_grid", "SELECT r_name, l.s AS size FROM region, (SELECT DISTINCT p_size AS s FROM part) l")
def j03(spark, d):
    """Product of two small parameter lists."""
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "part").select(F.col("p_size").alias("size")).distinct())


_SIZES = "s AS (SELECT feature_name AS f, count(*) AS n FROM feature_domain GROUP BY 1)"


def feature_sizes(spark, d) -> dict[str, int]:
    """Options of each feature, in the order of their names."""
    by = table(spark, d, "feature_domain").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))
    return {r.feature_name: r.n for r in sorted(bounded_rows(by, 1000, "features"))}


@query("J05_column_triples", f"WITH {_SIZES} SELECT x.f AS c1, y.f AS c2, z.f AS c3, x.n * y.n * z.n AS cells FROM s x, s y, s z WHERE x.f < y.f AND y.f < z.f")
def j05(spark, d):
    """Triples of the columns that the domain table lists, with their cells: metadata, made on the driver."""
    sizes = feature_sizes(spark, d)
    return spark.createDataFrame([(a, b, c, sizes[a] * sizes[b] * sizes[c]) for a, b, c in combinations(sizes, 3)], "c1 string, c2 string, c3 string, cells long")


@query("J07_prompt_and_text", "SELECT DISTINCT gen_id, input_text AS prompt, generated_text AS generation FROM generated_conditional")
def j07(spark, d):
    """Prompt and text of one row."""
    return table(spark, d, "generated_conditional").dropDuplicates(["gen_id"]).select("gen_id", F.col("input_text").alias("prompt"), F.col("generated_text").alias("generation"))


@query("J09_nearest_centroid", "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), f AS (SELECT e.vec_id, c.label, sum((x - m) ** 2) AS far FROM e JOIN c USING (i) GROUP BY ALL) SELECT vec_id, arg_min(label, far) AS nearest FROM f GROUP BY 1")
def j09(spark, d):
    """The nearest of the label means, of which there are few."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    centroids = means.select(F.collect_list(F.struct("label", F.transform("c", lambda z: z["m"]).alias("c"))).alias("cs"))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").crossJoin(F.broadcast(centroids))  # one row
    far = lambda z: F.aggregate(F.zip_with(F.col("embedding"), z["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.array_min(F.transform("cs", lambda z: F.struct(far(z).alias("distance"), z["label"].alias("label"))))["label"].alias("nearest"))


@query("J11_common_columns", "SELECT column_name FROM (DESCRIBE parsed_features_real) INTERSECT SELECT column_name FROM (DESCRIBE instruct_pairs)")
def j11(spark, d):
    """Columns that two tables share."""
    both = set(table(spark, d, "parsed_features_real").columns) & set(table(spark, d, "instruct_pairs").columns)
    return spark.createDataFrame([(c,) for c in sorted(both)], "column_name string")


# aggregations and sets


_ALL_PAIRS = " UNION ALL ".join(f"SELECT '{a}*{b}' AS metric, {a} AS x, {b} AS y, count(*) AS n FROM {REAL} GROUP BY 2, 3" for a, b in combinations(FEATURES, 2))


@query("A02_joint_counts", _ALL_PAIRS)
@query("A02_all_joint_counts", _ALL_PAIRS)
def a02(spark, d):
    """Joint counts of all pairs of the eight features, nulls kept, in one scan."""
    return divergence._pair_entries(real_features(spark, d), "real", FEATURES).groupBy("metric", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("A08_mean_over_pairs", "SELECT avg(n) AS mean FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def a08(spark, d):
    """A plain mean over groups."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_suppkey").alias("n")).agg(F.avg("n").alias("mean"))


@query("A15_summed_gradients", "SELECT i::INT AS i, sum(x::DOUBLE) / (SELECT count(*) FROM embeddings) AS mean FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1")
def a15(spark, d):
    """Element-wise sums of arrays over the rows of the whole batch."""
    each = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    rows = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("s")).crossJoin(F.broadcast(rows)).select("i", (F.col("s") / F.col("n")).alias("mean"))  # one row


@query("A21_gradient_norms", "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings")
def a21(spark, d):
    """Norm of each row's array."""
    return table(spark, d, "embeddings").select("vec_id", private_training.gradient_norm(F.col("embedding")).alias("norm"))


@query("U03_downward_closure", f"WITH {_SIZES} SELECT f AS clique FROM s UNION ALL SELECT x.f || ',' || y.f FROM s x, s y WHERE x.f < y.f")
def u03(spark, d):
    """Subsets of all pairs of the columns that the domain table lists."""
    return spark.createDataFrame([(",".join(sorted(q)),) for q in marginals.closure(combinations(feature_sizes(spark, d), 2))], "clique string")


@query("U04_union_with_side", "SELECT CASE vec_id % 2 WHEN 0 THEN 'p' ELSE 'q' END AS side, count(*) AS rows FROM embeddings GROUP BY 1")
def u04(spark, d):
    """Two matrices as one, split again by side."""
    e = table(spark, d, "embeddings")
    return mauve.joint(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 <> 0")).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


@query("U07_distinct_cliques", "SELECT DISTINCT l_returnflag || ',' || l_linestatus AS clique FROM lineitem")
def u07(spark, d):
    """Distinct pairs."""
    return table(spark, d, "lineitem").select(F.concat_ws(",", "l_returnflag", "l_linestatus").alias("clique")).distinct()


# functions


@query("F08_split_outside_stars", "SELECT doc_id, '*' || source || '|b*~(' || split || '|' || doc_id || ')~' || doc_id AS options FROM documents WHERE source IS NOT NULL AND split IS NOT NULL")
def f08(spark, d):
    """Options between bars outside parentheses and stars."""
    rows = table(spark, d, "documents").filter("source IS NOT NULL AND split IS NOT NULL")
    joined = F.concat(F.lit("*"), "source", F.lit("|b*|("), "split", F.lit("|"), "doc_id", F.lit(")|"), "doc_id")
    return rows.select("doc_id", F.array_join(text.split_nested(joined), "~").alias("options"))


@query("F12_joined_options", "SELECT feature_name, string_agg(option_text, '|' ORDER BY option_idx) AS options FROM feature_domain GROUP BY 1")
def f12(spark, d):
    """Options joined by bars."""
    by = table(spark, d, "feature_domain").groupBy("feature_name").agg(F.array_sort(F.collect_list(F.struct("option_idx", "option_text"))).alias("o"))
    return by.select("feature_name", F.array_join(F.transform("o", lambda x: x["option_text"]), "|").alias("options"))


@query("F27_array_padding", "SELECT l_orderkey, array_to_string(list_concat(list_slice(n, 1, 3), list_transform(range(greatest(0, 5 - least(3, len(n)))), lambda x: 0)), ',') AS padded FROM (SELECT l_orderkey, list(l_linenumber::BIGINT ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1)")
def f27(spark, d):
    """Arrays cut and padded."""
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.col("l_linenumber").cast("bigint"))), 1, 3).alias("n"))
    return by.select("l_orderkey", F.array_join(F.concat("n", F.array_repeat(F.lit(0).cast("bigint"), 5 - F.size("n"))).cast("array<string>"), ",").alias("padded"))


@query("D04_bin_middles", "SELECT ceil(l_quantity / 10) * 10 - 5 AS middle, count(*) AS rows FROM lineitem GROUP BY 1")
def d04(spark, d):
    """Quantities in bins, and back to the middles of their bins."""
    e = encoding.bins(encoding.Numerical(1, 50, kind="int"), [10, 20, 30, 40])
    coded = table(spark, d, "lineitem").select(e.forward(F.col("l_quantity")).alias("code"))
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).select(e.inverse(F.col("code")).cast("double").alias("middle"), "rows")


@query("D08_open_ends", "SELECT p_brand, (min(p_size) - 1)::DOUBLE AS whole, true AS below FROM part GROUP BY 1")
def d08(spark, d):
    """The largest number below the range of each brand, of whole and other numbers."""
    by = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    ends = [(r.p_brand, float(encoding.Numerical(r.low, r.high, kind="int").open_low), bool(r.low - 1e-9 < encoding.Numerical(r.low, r.high).open_low < r.low)) for r in bounded_rows(by, 10_000, "brands")]
    return spark.createDataFrame(ends, "p_brand string, whole double, below boolean")


# mechanisms and models


@query("M08_default_workload", f"WITH {_SIZES} SELECT x.f || ',' || y.f || ',' || z.f AS clique, 1e0 AS weight FROM s x, s y, s z WHERE x.f < y.f AND y.f < z.f AND x.n * y.n * z.n <= 2000")
def m08(spark, d):
    """Three-way cliques of the eight features, of at most 2,000 cells."""
    workload = marginals.default_workload(feature_sizes(spark, d), limit=2000)
    return spark.createDataFrame([(",".join(q), w) for q, w in workload.items()], "clique string, weight double")


@query("M09_model_size", f"WITH {_SIZES} SELECT x.f AS a, y.f AS b, z.f AS c, (x.n * y.n + y.n * z.n) * 8 / 1048576e0 AS megabytes FROM s x, s y, s z WHERE x.f < y.f AND y.f < z.f")
def m09(spark, d):
    """Size of the junction tree of two cliques that share a column, for all triples of features."""
    sizes = feature_sizes(spark, d)
    size = lambda a, b, c: float(graphical.model_megabytes({k: sizes[k] for k in (a, b, c)}, [(a, b), (b, c)]))
    return spark.createDataFrame([(*q, size(*q)) for q in combinations(sizes, 3)], "a string, b string, c string, megabytes double")


@query("M12_estimated_marginals", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders GROUP BY ALL")
def m12(spark, d):
    """A model fitted to exact marginals returns them."""
    df = table(spark, d, "orders")
    values = lambda c: sorted(r[0] for r in bounded_rows(df.select(c).distinct(), 1000, c))
    domains = {"s": values("o_orderstatus"), "p": values("o_orderpriority")}
    coded = encoding.encode(df.select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")), {c: encoding.categorical(encoding.Categorical(tuple(v))) for c, v in domains.items()})
    sizes = {c: len(v) for c, v in domains.items()}
    exact = marginals.vectors(coded, [("s", "p")], sizes)[("s", "p")]
    model = graphical.estimate(sizes, [graphical.Measurement(("s", "p"), exact.ravel(), 1.0)], 300, total=float(exact.sum()))
    got = np.round(model.project(("s", "p")), 0)
    return spark.createDataFrame([(domains["s"][i], domains["p"][j], float(got[i, j])) for i in range(sizes["s"]) for j in range(sizes["p"])], "s string, p string, n double")


@query("M14_sampled_rows")
def m14(spark, d):
    """Rows sampled from a model, by code."""
    model = graphical.Model({"a": 3, "b": 2}, [("a", "b")], 100.0)
    model.log[model.cliques[0]] = np.log(np.array([[8.0, 1], [1, 8], [1, 1]]))
    model.calibrate()
    return graphical.sample_rows(spark, model, 10_000, seed=5).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("M18_noise_searches")
def m18(spark, d):
    """Noise searches of one and two stages."""
    q, t, delta = 0.01, 500, 1e-5
    first = accounting.Stage(2.0, q, t)
    rows = [("training", accounting.training_sigma(4.0, delta, q, t)), ("numeric", accounting.noise_multiplier(4.0, delta, q, t)), ("stepped", accounting.stepped_sigma(4.0, delta, q, t)), ("second", accounting.second_stage_sigma(4.0, delta, first, q, t)), ("none", accounting.noise_multiplier(100.0, delta, q, t))]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "search string, sigma double")


@query("M11_adaptive_rounds")
def m11(spark, d):
    """The log of the adaptive rounds over the coded features, with a model of 1 MB."""
    options = aim.Options(iterations=100, model_megabytes=1.0)
    domains = {c: encoding.Categorical(tuple(v)) for c, v in domain_options(table(spark, d, "feature_domain")).items()}
    aim.synthesize(real_features(spark, d).drop("record_id"), domains, rho=0.5, rows=100, noise=aim.SeededNoise(1), options=options)
    return spark.createDataFrame([(i, ",".join(q), float(s), float(u), c) for i, (q, s, u, c) in enumerate(options.log)], "round int, clique string, sigma double, used double, candidates int")


@query("M30_delta_rule", "SELECT o_custkey, count(*) AS n, 1 / (count(*) * ln(count(*))) AS delta FROM orders GROUP BY 1 HAVING count(*) > 1")
def m30(spark, d):
    """delta of each group by its size."""
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return by.withColumn("delta", accounting.delta_rule(F.col("n")))


# evaluation


@query("E02_jensen_shannon", f"WITH h AS (SELECT sample_size AS v, count(*) FILTER (record_id % 2 = 0) AS a, count(*) FILTER (record_id % 2 <> 0) AS b FROM {REAL} WHERE sample_size IS NOT NULL GROUP BY 1), s AS (SELECT a * 1e0 / sum(a) OVER () AS p, b * 1e0 / sum(b) OVER () AS q FROM h) SELECT sqrt(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2) AS jsd FROM s")
def e02(spark, d):
    """Jensen-Shannon distance of one feature."""
    return divergence.category_divergence(*even_odd(spark, d), ["sample_size"]).select("jsd")


@query("E08_kept_components")
def e08(spark, d):
    """Bins of embeddings after PCA and k-means."""
    e = table(spark, d, "embeddings")
    real, synthetic = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 <> 0")
    bins = mauve.quantise(mauve.joint(real, synthetic), mauve.buckets(real.count(), synthetic.count()))
    return bins.groupBy("side").agg(F.count_distinct("bin").alias("bins"), F.count(F.lit(1)).alias("rows"))


@query("E14_language_model", r"WITH w AS (SELECT split = 'train' AS train, doc_id, string_split_regex(lower(text), '[\t-\r ]+') AS w FROM documents WHERE text IS NOT NULL AND split IS NOT NULL), p AS (SELECT train, unnest(list_slice(w, 1, len(w) - 1)) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM w WHERE len(w) > 1), c AS (SELECT train, a, b, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT a, max(struct_pack(n := n, b := b)).b AS guess FROM c WHERE train GROUP BY 1) SELECT sum(CASE WHEN guess = b THEN n ELSE 0 END) / sum(n)::DOUBLE AS accuracy FROM c LEFT JOIN g USING (a) WHERE NOT train")
def e14(spark, d):
    """Next-token accuracy of word pairs: the likeliest follower of each word, counted on training texts."""
    rows = table(spark, d, "documents").filter("text is not null and split is not null").select(F.expr("split = 'train'").alias("train"), F.split(F.lower("text"), r"[\t-\r ]+").alias("w"))
    pairs = rows.select("train", F.explode(F.arrays_zip(F.slice("w", 1, 1 << 30).alias("a"), F.slice("w", 2, 1 << 30).alias("b"))).alias("z")).select("train", F.col("z.a").alias("a"), F.col("z.b").alias("b")).filter("b is not null")
    counts = pairs.groupBy("train", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = counts.filter("train").groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("guess"))
    held = counts.filter("not train").join(best, "a", "left")
    return held.agg((F.sum(F.when(F.col("guess") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


# sources


@query("S03_reader_dispatch", "SELECT 'csv' AS kind, count(*) AS rows FROM nation UNION ALL SELECT 'json', count(*) FROM region UNION ALL SELECT 'orc', count(*) FROM supplier UNION ALL SELECT 'parquet', count(*) FROM part")
def s03(spark, d):
    """Readers by extension over tables written in four kinds."""
    from marginalia.plans.text_queries import _there_and_back

    made = {"csv": "nation", "jsonl": "region", "orc": "supplier", "parquet": "part"}
    counts = [(kind.removesuffix("l"), _there_and_back(spark, table(spark, d, name), kind).count()) for kind, name in made.items()]
    return spark.createDataFrame(counts, "kind string, rows long")


@query("S04_named_dataset", "SELECT 'Write a text that fits these features: ' || coalesce(category, '') AS instruction, text AS answer FROM documents WHERE split = 'train'")
def s04(spark, d):
    """A named dataset from a table at hand."""
    df = table(spark, d, "documents").select("category", F.col("text").alias("abstract"), "split")
    return files.load_dataset(spark, "biorxiv-category-condgen", {"train": df.filter("split = 'train'")}, "train")


@query("P29_dispatch_by_path", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'enron-condgen-topic' WHEN 1 THEN 'biorxiv' END AS name FROM documents")
def p29(spark, d):
    """The dataset that each path names, the longest name first."""
    kind = F.col("doc_id") % 3
    path = F.concat(F.lit("/data/"), F.when(kind == 0, "enron-condgen-topic").when(kind == 1, "biorxiv_v2").otherwise("other"), F.lit("/"), "doc_id")
    return table(spark, d, "documents").select("doc_id", named_in(path).alias("name"))


@query("S08_dense_matrix", "SELECT count(*) AS rows, min(len(embedding)) AS width FROM embeddings")
def s08(spark, d):
    """A dense matrix as rows of arrays."""
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("embedding")).cast("bigint").alias("width"))


_PROBS = "WITH z AS (SELECT vec_id, unnest(range(8)) AS token, unnest(embedding[1:8])::DOUBLE / 0.7 AS z FROM embeddings), q AS (SELECT *, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS q, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, token) AS k FROM z WINDOW w AS (PARTITION BY vec_id)), b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)"


@query("O07_filtered_sampling", f"{_PROBS} SELECT vec_id, token::INT AS token, round(q / sum(q) OVER (PARTITION BY vec_id), 4) AS share FROM b WHERE k <= 3 AND before < 0.4")
def o07(spark, d):
    """Tokens left after temperature, top-k and nucleus, with their shares, for the logits of every row."""

    @F.pandas_udf("array<double>")
    def kept(logits: pd.Series) -> pd.Series:
        return logits.map(lambda z: services.top_filtered(np.array(z, float), 3, 0.4, 0.7))

    rows = table(spark, d, "embeddings").select("vec_id", kept(F.slice("embedding", 1, 8)).alias("p"))
    return rows.select("vec_id", F.posexplode("p").alias("token", "share")).filter("share > 0").select("vec_id", "token", F.round("share", 4).alias("share"))


@query("X15_checked_rollouts", "SELECT count(*) AS rows FROM embeddings")
def x15(spark, d):
    """Rollouts that pass their checks."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("embedding").alias("query"), F.col("embedding").alias("response"), F.col("embedding").alias("logprobs"), F.col("label").alias("score"))
    return rollouts.check_rollouts(rows).agg(F.count(F.lit(1)).alias("rows"))


@query("X20_domain_labels", "SELECT doc_id, inferred_domain, inferred_domain IN (SELECT option_text FROM feature_domain WHERE feature_name = 'primary_research_area') AS known FROM domain_labels WHERE inferred_domain IS NOT NULL")
def x20(spark, d):
    """Labels checked against the list of domains."""
    known = table(spark, d, "feature_domain").filter("feature_name = 'primary_research_area'").select(F.col("option_text").alias("inferred_domain"), F.lit(True).alias("known"))
    rows = table(spark, d, "domain_labels").select("doc_id", "inferred_domain").dropna()
    return rows.join(known, "inferred_domain", "left").select("doc_id", "inferred_domain", F.coalesce("known", F.lit(False)).alias("known"))
