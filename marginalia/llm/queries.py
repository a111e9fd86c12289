"""Catalogue of this package's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import canonical, overlap, packing, pairs, pieces, terms, tokens, truncation
from marginalia.plans.catalogue import Catalogue, table
from marginalia.session import materialize

CATALOGUE = Catalogue()

TYPED_FIELDS = ("map_model_organism", "map_primary_research_area", "map_experimental_approach")


@CATALOGUE.query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed values with the item they mean."""
    return canonical.map_values(table(spark, d, "parsed_features_real"), "record_id", TYPED_FIELDS, table(spark, d, "feature_domain"))


@CATALOGUE.query("p2_unmatched")
def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no item, with the records that hold them."""
    mapped = canonical.map_values(table(spark, d, "parsed_features_real"), "record_id", TYPED_FIELDS, table(spark, d, "feature_domain"), scores=True)
    return mapped.filter("item_id = -1").groupBy("feature_name", "value").agg(F.count(F.lit(1)).alias("records"))


_TYPED = " UNION ALL ".join(f"SELECT DISTINCT record_id, '{c}' AS feature_name, {c} AS value FROM parsed_features_real WHERE regexp_matches({c}, '[^\\s\\p{{Z}}]') AND {c} NOT IN (SELECT option_text FROM feature_domain WHERE feature_name = '{c.removeprefix('map_')}')" for c in TYPED_FIELDS)


@CATALOGUE.query("p2_coverage", f"SELECT feature_name, count(*) AS rows, count(DISTINCT record_id) AS records, 0 AS strange FROM ({_TYPED}) GROUP BY 1")
def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that came out, each record once, and items that the domain table does not list for the field."""
    domain = table(spark, d, "feature_domain")
    found = canonical.map_values(table(spark, d, "parsed_features_real"), "record_id", TYPED_FIELDS, domain)
    known = domain.select(F.concat(F.lit("map_"), "feature_name").alias("feature_name"), "item_id", F.lit(0).alias("_known"))
    rows = found.join(F.broadcast(known), ["feature_name", "item_id"], "left")  # the domain table is metadata
    strange = F.count_if((F.col("item_id") != -1) & F.col("_known").isNull()).cast("int")
    return rows.groupBy("feature_name").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("record_id").alias("records"), strange.alias("strange"))


TERM_FIELDS = ("map_research_goal", "map_disease_mention", "map_sample_size")

_VALUES = " UNION ALL ".join(f"SELECT DISTINCT record_id, '{c}' AS feature_name, {c} AS value FROM parsed_features_real WHERE regexp_matches({c}, '[^\\s\\p{{Z}}]')" for c in TERM_FIELDS)
_TERMS = rf"""
WITH vals AS ({_VALUES}),
filled AS (SELECT feature_name, count(DISTINCT record_id) AS filled FROM vals GROUP BY 1),
occ AS (SELECT record_id, feature_name, unnest(regexp_extract_all(lower(value), '[\p{{L}}\p{{Nd}}]+')) AS term FROM vals),
counts AS (SELECT feature_name, term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM occ GROUP BY 1, 2),
judged AS (SELECT c.*, filled, CASE WHEN records > 0.1 * filled THEN 'common' WHEN records <= 2 THEN 'rare' ELSE 'useful' END AS verdict FROM counts c JOIN filled USING (feature_name))
"""


@CATALOGUE.query("p3_found", _TERMS + "SELECT feature_name, term, verdict FROM judged WHERE verdict <> 'useful'")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    judged = terms.term_verdicts(table(spark, d, "parsed_features_real"), "record_id", TERM_FIELDS)
    return judged.filter(F.col("verdict") != "useful").select("feature_name", "term", "verdict")


@CATALOGUE.query("p3_terms", _TERMS + "SELECT * FROM judged")
def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, records and verdict."""
    return terms.term_verdicts(table(spark, d, "parsed_features_real"), "record_id", TERM_FIELDS)


@CATALOGUE.query("p3_values", f"WITH vals AS ({_VALUES}) SELECT feature_name, value, count(DISTINCT record_id) AS records FROM vals GROUP BY ALL")
def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value with its records."""
    return terms.value_counts(terms.value_bitmaps(table(spark, d, "parsed_features_real"), "record_id", TERM_FIELDS))


@CATALOGUE.query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", tokens.load_vocabulary(spark))


@CATALOGUE.query("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    vocabulary = tokens.load_vocabulary(spark)
    return tokens.decode(tokens.encode(table(spark, d, "documents"), "doc_id", "text", vocabulary), "doc_id", vocabulary)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return truncation.records({"instruct_pairs": (table(spark, d, "instruct_pairs"), "pair_id", "answer"), "generated_conditional": (table(spark, d, "generated_conditional"), "gen_id", "generated_text")})


@CATALOGUE.query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Answers and generated texts that were cut off."""
    return truncation.cut_rows(_answers(spark, d))


@CATALOGUE.query("p5_shares")
def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut rows per table and source."""
    return truncation.cut_shares(_answers(spark, d))


@CATALOGUE.query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with the kind of defect."""
    return pairs.defects(table(spark, d, "instruct_pairs"))


@CATALOGUE.query("p6_empty", r"SELECT DISTINCT pair_id FROM instruct_pairs WHERE answer IS NULL OR NOT regexp_matches(answer, '[\p{L}\p{N}]') OR trim(trim(answer, chr(9) || chr(10) || ' '), '`\"''* ') = 'GENERATION_ERROR'")
def p6_empty(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose answer is empty."""
    return pairs.defects(table(spark, d, "instruct_pairs")).filter("defect = 'empty'").select("pair_id")


@CATALOGUE.query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cross-split overlaps as pairs, smaller key first."""
    found = overlap.cross_split_pairs(table(spark, d, "documents"))
    return found.select(F.least("t", "e").alias("doc_id_a"), F.greatest("t", "e").alias("doc_id_b"))


@CATALOGUE.query("p4_report")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records that overlap with the training split, and their pairs, per split and source."""
    return overlap.cross_split_counts(table(spark, d, "documents"))


CAPACITY, LIMIT, OVERLAP = 2048, 512, 64


def _packed(spark: SparkSession, d: str) -> DataFrame:
    size = tokens.count_tokens(tokens.load_vocabulary(spark))
    sized = table(spark, d, "documents").select("doc_id", size("text").alias("n_tokens"))
    return packing.assign(sized, "doc_id", "n_tokens", CAPACITY)


@CATALOGUE.query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, or of every piece of those above the capacity."""
    return _packed(spark, d)


@CATALOGUE.query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, items and used tokens, and the unused share."""
    return packing.fill(_packed(spark, d)).withColumn("unused_share", 1 - F.col("used") / (F.col("containers") * CAPACITY))


@CATALOGUE.query("p8_invariants", "SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS incomplete, 0::BIGINT AS needless_splits FROM documents")
def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, containers above the capacity, documents with tokens lost or doubled, documents split without need."""
    size = tokens.count_tokens(tokens.load_vocabulary(spark))
    sized = table(spark, d, "documents").select("doc_id", size("text").alias("n_tokens"))
    packed = materialize(packing.assign(sized, "doc_id", "n_tokens", CAPACITY), "packed")
    used = packed.groupBy("container").agg(F.sum("size").alias("_used"))
    own = packed.groupBy("doc_id").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_pieces"))
    n = F.coalesce("n_tokens", F.lit(0))
    each = sized.join(own, "doc_id", "left").agg(F.count("_pieces").alias("documents"), F.count_if(F.coalesce("_size", F.lit(-1)) != n).alias("incomplete"), F.count_if((F.col("_pieces") > 1) & (n <= CAPACITY)).alias("needless_splits"))
    return each.crossJoin(used.agg(F.count_if(F.col("_used") > CAPACITY).alias("overfull")))  # one row each


@CATALOGUE.query("p9_invariants", "SELECT 0::BIGINT AS broken")
def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pieces are too long, leave a gap, overlap too much, or are no stretches of the text from its start to its end."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cut = pieces.split_long(docs, "doc_id", "text", tokens.load_vocabulary(spark), LIMIT, OVERLAP)
    by = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "overlap", F.col("text").alias("t")))).alias("p")).join(docs, "doc_id")
    at = lambda i: F.element_at("p", i)
    good = F.forall("p", lambda x: (x["end"] - x["start"] <= LIMIT) & (x["overlap"].between(0, OVERLAP)) & F.contains(F.col("text"), x["t"]))
    joined = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: a["end"] == b["start"] + b["overlap"]), lambda x: F.coalesce(x, F.lit(True)))
    whole = (at(1)["start"] == 0) & F.startswith(F.col("text"), at(1)["t"]) & F.endswith(F.col("text"), at(-1)["t"])
    return by.agg(F.count_if(~(good & joined & whole)).alias("broken"))


@CATALOGUE.query("p9_pieces")
def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of every document above the limit."""
    return pieces.split_long(table(spark, d, "documents"), "doc_id", "text", tokens.load_vocabulary(spark), LIMIT, OVERLAP)
