"""Queries over feature tables: counts, encodings, divergences, set operations, sampling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import divergence, encoding, marginals, sampling
from marginalia.operators.ingest import domain_options
from marginalia.plans.catalogue import Catalogue, table
from marginalia.plans.ingest_queries import _split, p1_loaded_sql
from marginalia.session import bounded_rows, materialize

CATALOGUE = Catalogue()
query = CATALOGUE.query

FEATURES = ("primary_research_area", "model_organism", "experimental_approach", "dominant_data_type", "research_focus_scale", "disease_mention", "sample_size", "research_goal")
REAL = "(SELECT DISTINCT ON (record_id) record_id, " + ", ".join(f"map_{f} AS {f}" for f in FEATURES) + " FROM parsed_features_real ORDER BY record_id)"
SYNTH = "(SELECT DISTINCT ON (row_id) row_id, " + ", ".join(f"generated_text ->> '$.{f}' AS {f}" for f in FEATURES) + " FROM synthetic_features WHERE json_valid(generated_text) AND starts_with(generated_text, '{') ORDER BY row_id)"


def real_features(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "parsed_features_real").dropDuplicates(["record_id"])
    return df.select("record_id", *[F.col(f"map_{f}").alias(f) for f in FEATURES])


def even_odd(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records with an even and an odd id stand for the real and the synthetic table."""
    df = real_features(spark, d)
    return df.filter("record_id % 2 = 0"), df.filter("record_id % 2 <> 0")


def _one_way_sql(columns, real: str = f"(SELECT * FROM {REAL} WHERE record_id % 2 = 0)", synth: str = f"(SELECT * FROM {REAL} WHERE record_id % 2 <> 0)") -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS metric, v.*, a.all_real, a.all_synth, sum(n_real) OVER () AS have_real, sum(n_synth) OVER () AS have_synth
  FROM (SELECT coalesce(r.v, s.v) AS value, coalesce(n1, 0) AS n_real, coalesce(n2, 0) AS n_synth FROM
    (SELECT {c} AS v, count(*) AS n1 FROM {real} WHERE {c} IS NOT NULL GROUP BY 1) r FULL JOIN
    (SELECT {c} AS v, count(*) AS n2 FROM {synth} WHERE {c} IS NOT NULL GROUP BY 1) s ON r.v = s.v) v,
  (SELECT (SELECT count(*) FROM {real}) AS all_real, (SELECT count(*) FROM {synth}) AS all_synth) a""")
    return "SELECT metric, " + _DISTANCES + " FROM (" + " UNION ALL ".join(parts) + ") GROUP BY metric"


_P, _Q = "(n_real * 1e0 / have_real)", "(n_synth * 1e0 / have_synth)"
_DISTANCES = f"""sum(abs(n_real * 1e0 / all_real - n_synth * 1e0 / all_synth)) / 2 AS tvd,
  sqrt(greatest(sum(CASE WHEN n_real > 0 THEN {_P} * ln(2 * {_P} / ({_P} + {_Q})) ELSE 0 END + CASE WHEN n_synth > 0 THEN {_Q} * ln(2 * {_Q} / ({_P} + {_Q})) ELSE 0 END) / 2, 0)) AS jsd,
  count(*) FILTER (n_real > 0) AS unique_real, count(*) FILTER (n_synth > 0) AS unique_synth"""


def _pairs_sql() -> str:
    parts = []
    for a, b in combinations(FEATURES, 2):
        parts.append(f"""SELECT '{a}*{b}' AS metric, coalesce(n1, 0) AS n_real, coalesce(n2, 0) AS n_synth, sum(coalesce(n1, 0)) OVER () AS all_real, sum(coalesce(n2, 0)) OVER () AS all_synth, sum(coalesce(n1, 0)) OVER () AS have_real, sum(coalesce(n2, 0)) OVER () AS have_synth FROM
  (SELECT {a} AS x, {b} AS y, count(*) AS n1 FROM feats WHERE record_id % 2 = 0 GROUP BY 1, 2) r FULL JOIN
  (SELECT coalesce({a}, 'NA (added)') AS x, coalesce({b}, 'NA (added)') AS y, count(*) AS n2 FROM feats WHERE record_id % 2 <> 0 GROUP BY 1, 2) s ON r.x IS NOT DISTINCT FROM s.x AND r.y IS NOT DISTINCT FROM s.y""")
    return f"WITH feats AS MATERIALIZED {REAL} SELECT metric, {_DISTANCES} FROM (" + " UNION ALL ".join(parts) + ") GROUP BY metric"


@query("E03_category_divergence", _one_way_sql(FEATURES))
def e03(spark, d):
    """Total variation, Jensen-Shannon distance and categories of each feature."""
    return divergence.category_divergence(*even_odd(spark, d), FEATURES)


@query("E04_pair_divergence", _pairs_sql())
def e04(spark, d):
    """The same of each pair of features."""
    return divergence.pair_divergence(*even_odd(spark, d), FEATURES)


@query("E04_mean_pair_divergence", f"SELECT avg(tvd) AS tvd, avg(jsd) AS jsd FROM ({_pairs_sql()})")
def e04_mean(spark, d):
    """Means over all pairs of features."""
    return divergence.mean_pair_divergence(*even_odd(spark, d), FEATURES)


def _report_sql() -> str:
    pairs = []
    for a, b in combinations(FEATURES, 2):
        pairs.append(f"""SELECT '{a}*{b}' AS metric, coalesce(n1, 0) AS n_real, coalesce(n2, 0) AS n_synth, sum(coalesce(n1, 0)) OVER () AS all_real, sum(coalesce(n2, 0)) OVER () AS all_synth, sum(coalesce(n1, 0)) OVER () AS have_real, sum(coalesce(n2, 0)) OVER () AS have_synth FROM
  (SELECT {a} AS x, {b} AS y, count(*) AS n1 FROM feats GROUP BY 1, 2) r FULL JOIN
  (SELECT coalesce({a}, 'NA (added)') AS x, coalesce({b}, 'NA (added)') AS y, count(*) AS n2 FROM made GROUP BY 1, 2) s ON r.x IS NOT DISTINCT FROM s.x AND r.y IS NOT DISTINCT FROM s.y""")
    two = f"SELECT avg(tvd) AS tvd, avg(jsd) AS jsd FROM (SELECT metric, {_DISTANCES} FROM ({' UNION ALL '.join(pairs)}) GROUP BY metric)"
    return f"WITH feats AS MATERIALIZED {REAL}, made AS MATERIALIZED ({p1_loaded_sql()}), one AS ({_one_way_sql(FEATURES, 'feats', 'made')}) SELECT * FROM one UNION ALL SELECT '2way', tvd, jsd, NULL, NULL FROM ({two})"


@query("E05_divergence_report", _report_sql())
def e05(spark, d):
    """Real features against the loaded synthetic records."""
    return divergence.divergence_report(real_features(spark, d), materialize(_split(spark, d)[0], "loaded"), FEATURES)


@query("E01_tvd_by_language", """WITH c AS (SELECT lang AS v, count(*) FILTER (doc_id % 2 = 0) * 1e0 / (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS p, count(*) FILTER (doc_id % 2 <> 0) * 1e0 / (SELECT count(*) FROM documents WHERE doc_id % 2 <> 0) AS q FROM documents GROUP BY 1)
SELECT sum(abs(p - q)) / 2 AS tvd FROM c WHERE v IS NOT NULL""")
def e01(spark, d):
    """Total variation of the languages of even and odd documents."""
    df = table(spark, d, "documents")
    return divergence.category_divergence(df.filter("doc_id % 2 = 0"), df.filter("doc_id % 2 <> 0"), ["lang"]).select("tvd")


@query("J01_histogram_alignment", " UNION ALL ".join(f"SELECT '{f}' AS metric, {f} AS value, count(*) FILTER (record_id % 2 = 0) AS n_real, count(*) FILTER (record_id % 2 <> 0) AS n_synth FROM {REAL} GROUP BY 2" for f in FEATURES))
def j01(spark, d):
    """Aligned histograms of two tables."""
    return divergence.category_counts(*even_odd(spark, d), FEATURES)


_OPTIONS = "o AS (SELECT feature_name, last(option_text ORDER BY option_idx) AS last FROM feature_domain GROUP BY 1)"


@query("E15_last_option_report", f"WITH {_OPTIONS}, r AS ({' UNION ALL '.join(f'''SELECT '{f}' AS feature, count(*) AS rows, count(*) FILTER ({f} = (SELECT last FROM o WHERE feature_name = '{f}')) AS exact, count(*) FILTER (regexp_matches(lower({f}), 'other|not applicable')) AS named FROM {REAL}''' for f in FEATURES)}) SELECT feature, rows, CASE WHEN exact > 0 THEN exact ELSE named END AS hits, 100e0 * (CASE WHEN exact > 0 THEN exact ELSE named END) / rows AS percent FROM r")
def e15(spark, d):
    """Rows that took the last option of each feature."""
    rows = sorted(bounded_rows(table(spark, d, "feature_domain").select("feature_name", "option_idx", "option_text"), 20_000, "feature domain"))
    options: dict[str, list[str]] = {}
    for r in rows:
        options.setdefault(r.feature_name, []).append(r.option_text)
    return divergence.last_option_shares(real_features(spark, d), {f: options[f] for f in FEATURES})


# aggregations


@query("A01_value_counts", f"SELECT disease_mention AS value, count(*) AS n, count(*) * 1e0 / (SELECT count(*) FROM {REAL}) AS share FROM {REAL} WHERE disease_mention IS NOT NULL GROUP BY 1")
def a01(spark, d):
    """Counts of values without nulls; shares of all rows."""
    df = real_features(spark, d)
    counts = df.groupBy(F.col("disease_mention").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).filter("value is not null").select("value", "n", (F.col("n") / F.col("_all")).alias("share"))  # total: one row


_CODED = "SELECT l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_quantity > 40 THEN 4 WHEN l_quantity > 30 THEN 3 WHEN l_quantity > 20 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS qty FROM lineitem"
_CLIQUES = marginals.closure([("flag", "qty", "status")])


def _coded(spark, d):
    quantity = encoding.bins(encoding.Numerical(0, 50), [10, 20, 30, 40])
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), quantity.forward(F.col("l_quantity")).alias("qty"))


@query("A04_all_marginals", f"WITH t AS ({_CODED}) " + " UNION ALL ".join(f"SELECT '{','.join(q)}' AS clique, [{', '.join(f'{c}::VARCHAR' for c in q)}] AS cell, count(*) AS n FROM t GROUP BY {', '.join(q)}" for q in _CLIQUES))
def a04(spark, d):
    """All marginals of the downward closure in one scan."""
    return marginals.marginal_counts(_coded(spark, d), _CLIQUES)


@query("A03_three_way_marginal", f"WITH t AS ({_CODED}) SELECT flag, status, qty, count(*) AS n FROM t GROUP BY ALL")
def a03(spark, d):
    """Counts of one clique."""
    return _coded(spark, d).groupBy("flag", "status", "qty").agg(F.count(F.lit(1)).alias("n"))


@query("J12_dense_marginal", """WITH t AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS f, CASE WHEN l_quantity > 100 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END AS q FROM lineitem)
SELECT a.f::INT AS f, b.q::INT AS q, (SELECT count(*) FROM t WHERE t.f = a.f AND t.q = b.q) AS n FROM (SELECT unnest(range(3)) AS f) a, (SELECT unnest(range(3)) AS q) b""")
def j12(spark, d):
    """Every cell of a domain, zeros included."""
    flag, quantity = encoding.categorical(encoding.Categorical(("A", "N", "R"))), encoding.bins(encoding.Numerical(0, 1000), [25, 100])
    df = table(spark, d, "lineitem").select(flag.forward(F.col("l_returnflag")).alias("f"), quantity.forward(F.col("l_quantity")).alias("q"))
    return marginals.dense(df, ("f", "q"), {"f": 3, "q": 3})


@query("A07_distinct_categories", "SELECT " + ", ".join(f"count(DISTINCT {f}) AS {f}" for f in FEATURES) + f" FROM {REAL}")
def a07(spark, d):
    """Distinct categories of each feature."""
    return real_features(spark, d).agg(*[F.count_distinct(f).alias(f) for f in FEATURES])


@query("A09_conditional_share", "SELECT count(*) FILTER (l_discount > 0.05) AS hits, 100e0 * count(*) FILTER (l_discount > 0.05) / count(*) AS percent FROM lineitem")
def a09(spark, d):
    """Rows that meet a condition, and their percentage."""
    hit = F.count_if(F.col("l_discount") > 0.05)
    return table(spark, d, "lineitem").agg(hit.alias("hits"), (100.0 * hit / F.count(F.lit(1))).alias("percent"))


@query("A18_minimum_variance_total", """WITH m AS (SELECT 'flag' AS clique, l_returnflag AS cell, count(*) * 1e0 AS n, 2e0 AS s FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) * 1e0, 3e0 FROM lineitem GROUP BY 2),
t AS (SELECT clique, sum(n) AS t, sum(s * s) AS v FROM m GROUP BY 1) SELECT sum(t / v) / sum(1 / v) AS total, 1 / sum(1 / v) AS variance FROM t""")
def a18(spark, d):
    """Total with least variance from two measured marginals."""
    counts = marginals.marginal_counts(_coded(spark, d), [("flag",), ("status",)])
    return marginals.total_estimate(counts.select("clique", F.col("n").cast("double").alias("noisy"), F.when(F.col("clique") == "flag", 2.0).otherwise(3.0).alias("stddev")))


@query("A05_compressed_measurement", """WITH m AS (SELECT o_orderpriority AS cell, count(*) * 1e0 AS n, (CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END)::INT AS new_code FROM orders GROUP BY 1)
SELECT 'priority' AS clique, new_code, sum(n) / sqrt(count(*)) AS value, 1 / sqrt(count(*)) AS coef, 2e0 AS stddev FROM m GROUP BY new_code""")
def a05(spark, d):
    """Noisy counts summed over merged codes, scaled by the root of the codes merged."""
    counts = marginals.marginal_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority")), [("priority",)])
    coded = counts.withColumn("new_code", F.when(F.element_at("cell", 1) < "3", 0).otherwise(1)).withColumn("noisy", F.col("n").cast("double")).withColumn("stddev", F.lit(2.0))
    return marginals.compress(coded)


@query("A19_sensitivity_and_norms", """WITH c AS (SELECT o_orderstatus AS k, count(*) FILTER (o_orderkey % 2 = 0) - count(*) FILTER (o_orderkey % 2 <> 0) AS d FROM orders GROUP BY 1)
SELECT max(abs(d)) AS largest, sum(abs(d)) AS l1, sqrt(sum(d * d)) AS l2 FROM c""")
def a19(spark, d):
    """Largest difference, L1 and L2 norm of two count vectors."""
    even = F.col("o_orderkey") % 2 == 0
    diff = table(spark, d, "orders").groupBy("o_orderstatus").agg((F.count_if(even) - F.count_if(~even)).alias("d"))
    return diff.agg(F.max(F.abs("d")).alias("largest"), F.sum(F.abs("d")).alias("l1"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"))


# encodings


@query("D01_discrete_encoder", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 0 END::INT AS code FROM orders")
def d01(spark, d):
    """Values to codes; unknown ones take the first."""
    e = encoding.categorical(encoding.Categorical(("1-URGENT", "2-HIGH", "3-MEDIUM")))
    return table(spark, d, "orders").select("o_orderkey", e.forward(F.col("o_orderpriority")).alias("code"))


@query("D02_right_closed_bins", "SELECT c_custkey, (CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 0 WHEN c_acctbal <= 1000 THEN 1 WHEN c_acctbal <= 5000 THEN 2 ELSE 3 END)::INT AS code FROM customer")
def d02(spark, d):
    """Right-closed bins, with a code for what lies outside."""
    e = encoding.bins(encoding.Numerical(0, 9000, clip=False), [1000, 5000])
    return table(spark, d, "customer").select("c_custkey", e.forward(F.col("c_acctbal")).alias("code"))


@query("D03_uniform_bins", "SELECT p_partkey, greatest(0, least(4, ceil(p_size / 10.0) - 1))::INT AS code, (greatest(0, least(4, ceil(p_size / 10.0) - 1)) * 10 + 5)::DOUBLE AS middle FROM part")
def d03(spark, d):
    """Equal-width bins of whole numbers, and back to their middles."""
    e = encoding.uniform_bins(encoding.Numerical(1, 50, kind="int"), 5)
    code = e.forward(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", code.alias("code"), e.inverse(code).alias("middle"))


@query("D05_rare_value_merge", "WITH m AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 3 ELSE 0 END AS c FROM part) SELECT p_partkey, (CASE c WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END)::INT AS code FROM m")
def d05(spark, d):
    """Rare codes share the last code; composed with the encoder."""
    e = encoding.merge_rare([True, False, True, False]) @ encoding.categorical(encoding.Categorical(("ECONOMY", "STANDARD", "PROMO", "SMALL")))
    return table(spark, d, "part").select("p_partkey", e.forward(F.col("p_type")).alias("code"))


@query("D06_encode_decode", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN o_orderstatus ELSE 'F' END AS o_orderstatus FROM orders")
def d06(spark, d):
    """Encoding and its inverse over a table."""
    e = {"o_orderstatus": encoding.categorical(encoding.Categorical(("F", "O", "P")))}
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return encoding.encode(encoding.encode(df, e, drop_others=False), e, reverse=True, drop_others=False)


@query("D09_domain_options", "SELECT feature_name, count(*) AS options FROM feature_domain GROUP BY 1")
def d09(spark, d):
    """Options of each feature of a domain table."""
    options = domain_options(table(spark, d, "feature_domain"))
    return spark.createDataFrame([(k, len(v)) for k, v in options.items()], "feature_name string, options long")


@query("D01_out_of_domain", f"WITH f AS (SELECT * FROM {REAL}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN (SELECT option_text FROM feature_domain WHERE feature_name = '{c}')) AS rows FROM f" for c in FEATURES))
def ood(spark, d):
    """Values outside the domain, by feature."""
    options = domain_options(table(spark, d, "feature_domain"))
    return encoding.out_of_domain(real_features(spark, d), {f: encoding.Categorical(tuple(options[f])) for f in FEATURES})


# projections, filters, sampling


@query("P06_fill_nulls", f"SELECT record_id, coalesce(disease_mention, 'NA (added)') AS disease_mention FROM {REAL}")
def p06(spark, d):
    """Nulls filled with a constant."""
    return real_features(spark, d).select("record_id", "disease_mention").fillna("NA (added)")


@query("P07_drop_nulls", "SELECT doc_id, inferred_domain FROM domain_labels WHERE inferred_domain IS NOT NULL AND quality IS NOT NULL")
def p07(spark, d):
    """Rows without nulls in chosen columns."""
    return table(spark, d, "domain_labels").dropna(subset=["inferred_domain", "quality"]).select("doc_id", "inferred_domain")


@query("P02_rename_columns", "SELECT doc_id, text AS abstract, lang AS inferred_lang FROM documents")
def p02(spark, d):
    """Kept and renamed columns, one of them with a computed name."""
    df = table(spark, d, "documents").select("doc_id", "text", "lang")
    return df.withColumnsRenamed({"text": "abstract"}).withColumn(f"inferred_{'lang'}", F.col("lang")).drop("lang")


_U = "(('0x' || substr(md5(concat_ws('|', {k}, '42')), 1, 12))::BIGINT + 0.5e0) / 281474976710656e0"


@query("P11_uniform_sample", f"SELECT doc_id FROM documents ORDER BY {_U.format(k='doc_id')}, doc_id LIMIT 100")
def p11(spark, d):
    """Exactly n rows, chosen by a keyed hash."""
    return sampling.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 100, seed=42)


@query("P12_stratified_split", f"WITH r AS (SELECT doc_id, inferred_domain, row_number() OVER (PARTITION BY inferred_domain ORDER BY {_U.format(k='doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY inferred_domain) AS n FROM domain_labels WHERE inferred_domain IS NOT NULL) SELECT doc_id, inferred_domain, CASE WHEN k <= round(0.1e0 * n) THEN 'validation' ELSE 'train' END AS split FROM r")
def p12(spark, d):
    """Ninety to ten within each label."""
    return sampling.stratified_split(table(spark, d, "domain_labels").dropna(subset=["inferred_domain"]).select("doc_id", "inferred_domain"), "doc_id", "inferred_domain", 0.1, seed=42)


@query("P13_offset_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 14000")
def p13(spark, d):
    """Rows from an offset on."""
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(14000)


@query("P14_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def p14(spark, d):
    """First rows."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query("P15_replicate_rows", "SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber)) ::INT AS copy FROM lineitem WHERE l_linenumber > 0")
def p15(spark, d):
    """Each row as often as a column says."""
    return sampling.replicate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", "copy")


@query("P23_shuffled_batches", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_U.format(k='doc_id')}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, (k // 32)::BIGINT AS batch FROM r WHERE k // 32 < n // 32")
def p23(spark, d):
    """Full batches of a seeded shuffle; the incomplete last one is dropped."""
    return sampling.shuffled_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32, seed=42)


@query("P15_poisson_batches", f"SELECT s.step, doc_id FROM documents, (SELECT unnest(range(4)) AS step) s WHERE (('0x' || substr(md5(concat_ws('|', doc_id, s.step, '42')), 1, 12))::BIGINT + 0.5e0) / 281474976710656e0 < 0.05")
def poisson(spark, d):
    """Poisson-sampled batches, as the accounting assumes."""
    return sampling.poisson_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 4, 0.05, seed=42).select("step", "doc_id")


# set operations, joins


@query("U01_category_union", f"SELECT DISTINCT disease_mention AS value FROM {REAL} WHERE disease_mention IS NOT NULL UNION SELECT option_text FROM feature_domain WHERE feature_name = 'disease_mention'")
def u01(spark, d):
    """Union of two category sets."""
    a = real_features(spark, d).select(F.col("disease_mention").alias("value")).dropna()
    return a.union(table(spark, d, "feature_domain").filter("feature_name = 'disease_mention'").select("option_text")).distinct()


@query("U08_label_codes", "WITH l AS (SELECT DISTINCT inferred_domain FROM domain_labels WHERE inferred_domain IS NOT NULL) SELECT inferred_domain, (row_number() OVER (ORDER BY inferred_domain) - 1)::INT AS code FROM l")
def u08(spark, d):
    """Distinct labels, coded in alphabetical order."""
    return sampling.label_codes(table(spark, d, "domain_labels"), "inferred_domain")


@query("U02_key_sets", "SELECT event_id, len(list_intersect(json_keys(props), ['k', 'm'])) AS common, len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'm'))) AS extra, len(list_filter(['k', 'm'], lambda x: NOT list_contains(json_keys(props), x))) AS missing FROM events")
def u02(spark, d):
    """Keys of a JSON object against an expected set."""
    keys, want = F.json_object_keys("props"), F.array(F.lit("k"), F.lit("m"))
    size = lambda c: F.size(c).cast("bigint")
    return table(spark, d, "events").select("event_id", size(F.array_intersect(keys, want)).alias("common"), size(F.array_except(keys, want)).alias("extra"), size(F.array_except(want, keys)).alias("missing"))


@query("J02_code_lookup", "SELECT record_id, coalesce(option_idx, 0)::INT AS code FROM (SELECT DISTINCT ON (record_id) record_id, map_model_organism AS v FROM parsed_features_real ORDER BY record_id) r LEFT JOIN (SELECT * FROM feature_domain WHERE feature_name = 'model_organism') d ON v = option_text")
def j02(spark, d):
    """Codes by a join with the domain table, with a default."""
    codes = table(spark, d, "feature_domain").filter("feature_name = 'model_organism'").select(F.col("option_text").alias("model_organism"), "option_idx")
    return real_features(spark, d).select("record_id", "model_organism").join(codes, "model_organism", "left").select("record_id", F.coalesce("option_idx", F.lit(0)).alias("code"))


@query("J04_column_pairs", "SELECT a.feature_name AS c1, b.feature_name AS c2, count(*) AS cells FROM feature_domain a, feature_domain b WHERE a.feature_name < b.feature_name GROUP BY 1, 2")
def j04(spark, d):
    """Pairs of the columns that the domain table lists, with their cells."""
    sizes = table(spark, d, "feature_domain").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))  # metadata: a row for each column
    a, b = sizes.select(F.col("feature_name").alias("c1"), F.col("n").alias("n1")), sizes.select(F.col("feature_name").alias("c2"), F.col("n").alias("n2"))
    return a.join(F.broadcast(b), F.col("c1") < F.col("c2")).select("c1", "c2", (F.col("n1") * F.col("n2")).alias("cells"))


@query("J06_fuzzy_field_match", "SELECT feature_name, column_name FROM (SELECT f.feature_name, c AS column_name, row_number() OVER (PARTITION BY f.feature_name ORDER BY c) AS k FROM (SELECT DISTINCT feature_name FROM feature_domain) f, (SELECT unnest(['Model Organism Name', 'goal', 'Sample Size', 'scale']) AS c) WHERE contains(replace(lower(f.feature_name), '_', ' '), replace(lower(c), '_', ' ')) OR contains(replace(lower(c), '_', ' '), replace(lower(f.feature_name), '_', ' '))) WHERE k = 1")
def j06(spark, d):
    """Field names matched where either contains the other; the first wins."""
    return sampling.fuzzy_fields(table(spark, d, "feature_domain").select("feature_name").distinct(), ["Model Organism Name", "goal", "Sample Size", "scale"])


@query("J08_joint_pairs", f"SELECT sample_size, research_goal, count(*) AS n FROM {REAL} GROUP BY ALL")
def j08(spark, d):
    """Joint counts of two columns, nulls kept."""
    return real_features(spark, d).groupBy("sample_size", "research_goal").agg(F.count(F.lit(1)).alias("n"))
