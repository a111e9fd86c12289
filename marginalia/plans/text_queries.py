"""Queries over texts: JSON parsing, option lists, templates, token rows, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import prompts, services, text
from marginalia.functions.text import NumberedSchema
from marginalia.operators import tokenised
from marginalia.plans.catalogue import Catalogue, table
from marginalia.session import work_dir
from marginalia.sources import files
from marginalia.sources.registry import Recipe

CATALOGUE = Catalogue()
query = CATALOGUE.query

_LINES = "(SELECT DISTINCT row_id, generated_text AS t FROM synthetic_features)"
_TRIM = r"regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')"
_UNFENCED = rf"CASE WHEN starts_with({_TRIM}, '```') THEN regexp_replace(regexp_replace(regexp_replace({_TRIM}, '^```(json)?\s*', ''), '```$', ''), '\s+$', '') ELSE {_TRIM} END"
_STRICT = r"json_valid({b}) AND NOT regexp_matches({b}, ',\s*[}}\]]') AND NOT regexp_matches({b}, '(NaN|Infinity)')"


def lines(spark, d) -> DataFrame:
    return table(spark, d, "synthetic_features").select("row_id", F.col("generated_text").alias("t")).dropDuplicates(["row_id"])


@query("F01_strip_fence", f"SELECT row_id, {_UNFENCED} AS body FROM {_LINES}")
def f01(spark, d):
    """Texts without surrounding fences."""
    return lines(spark, d).select("row_id", text.without_fence(F.col("t")).alias("body"))


@query("F02_parse_or_literal")
def f02(spark, d):
    """JSON, else a literal, else an empty map."""
    return lines(spark, d).select("row_id", text.parse_or_literal("t").alias("parsed"))


@query("F03_parse_sliced", f"SELECT row_id, CASE WHEN {_STRICT.format(b='substr(t, 8, greatest(length(t) - 10, 0))')} AND json_type(substr(t, 8, greatest(length(t) - 10, 0))) = 'OBJECT' THEN 'sliced' WHEN {_STRICT.format(b='t')} AND json_type(t) = 'OBJECT' THEN 'whole' END AS how FROM {_LINES}")
def f03(spark, d):
    """Which of the slice and the whole of a text is a JSON object."""
    rows = lines(spark, d)
    inner = text.parse_sliced(F.concat(F.lit("```json"), F.substring("t", F.lit(8), F.greatest(F.length("t") - 10, F.lit(0))), F.lit("```")))
    both = rows.select("row_id", inner.isNotNull().alias("a"), text.parse_sliced("t").isNotNull().alias("b"))
    return both.select("row_id", F.when(F.col("a"), "sliced").when(F.col("b"), "whole").alias("how"))


@query("A10_parse_success", f"SELECT count(*) AS rows, count(*) FILTER ({_STRICT.format(b='b')} AND CASE WHEN json_valid(b) THEN json_type(b) END = 'OBJECT') AS parsed FROM (SELECT {_UNFENCED} AS b FROM {_LINES})")
def a10(spark, d):
    """Texts that parse as JSON objects."""
    keys = text._object_keys(text.without_fence(F.col("t")))
    return lines(spark, d).select(keys.isNotNull().alias("ok")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("ok").alias("parsed"))


@query("F04_canonical_json", "SELECT event_id, replace(props, ' ', '') AS props FROM events")
def f04(spark, d):
    """JSON in compact form."""
    return table(spark, d, "events").select("event_id", text.canonical_json("props").alias("props"))


@query("P05_json_to_columns", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def p05(spark, d):
    """JSON text as typed columns."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("j")).select("event_id", "j.*")


@query("F07_split_options", "SELECT doc_id, list_filter(list_transform(str_split(coalesce(category, '') || '|' || source || '||' || coalesce(lang, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS options FROM documents")
def f07(spark, d):
    """Options between bars."""
    joined = F.concat(F.coalesce("category", F.lit("")), F.lit("|"), F.col("source"), F.lit("||"), F.coalesce("lang", F.lit("")))
    return table(spark, d, "documents").select("doc_id", text.split_options(joined).alias("options"))


@query("F06_schema_fields", "SELECT feature_name AS name, list(option_text ORDER BY option_idx) AS options FROM feature_domain GROUP BY 1")
def f06(spark, d):
    """Fields of a schema text written from the domain table and parsed again."""
    domain = table(spark, d, "feature_domain").groupBy("feature_name").agg(F.array_sort(F.collect_list(F.struct("option_idx", "option_text"))).alias("o"))
    written = domain.select(text.schema_text(F.col("feature_name"), F.transform("o", lambda x: x["option_text"])).alias("s"))
    return written.select(F.explode(text.schema_fields(F.col("s"))).alias("f")).select("f.*")


@query("F09_numbered_schema", "SELECT feature_name AS name, string_agg(option_text, '~' ORDER BY option_idx) AS options, 'what a text says of ' || replace(feature_name, '_', ' ') AS description FROM feature_domain GROUP BY 1")
def f09(spark, d):
    """Numbered feature lists as models write them, made from the domain table and parsed by a table function."""
    by = table(spark, d, "feature_domain").groupBy("feature_name").agg(F.array_sort(F.collect_list(F.struct("option_idx", "option_text"))).alias("o"))
    spaced = F.translate("feature_name", "_", " ")
    values = F.concat(F.lit('"'), F.array_join(F.transform("o", lambda x: x["option_text"]), '", "'), F.lit('"'))
    written = by.select(F.concat(F.lit("1. **"), F.initcap(spaced), F.lit("**:\n   Possible values: "), values, F.lit("\n   Description: what a text says of "), spaced).alias("t"))
    return written.lateralJoin(NumberedSchema(F.col("t").outer())).select("name", F.array_join("options", "~").alias("options"), "description")


@query("F17_templates", "SELECT doc_id, 'Field {' || coalesce(category, '') || '}: ' || coalesce(title, '') AS prompt FROM documents")
def f17(spark, d):
    """Named placeholders and doubled braces."""
    return table(spark, d, "documents").select("doc_id", text.fill_template("Field {{{field}}}: {title}", {"field": F.col("category"), "title": F.col("title")}).alias("prompt"))


@query("F11_name_normalise", "SELECT doc_id, replace(lower(category), ' ', '_') AS snake, translate(lower(category), '_', ' ') AS spaced FROM documents")
def f11(spark, d):
    """Names in lower case with underscores, and back."""
    return table(spark, d, "documents").select("doc_id", text.snake(F.col("category")).alias("snake"), text.spaced(F.col("category")).alias("spaced"))


@query("F13_judged_score", r"""SELECT event_id, TRY_CAST(nullif(regexp_extract('{"holistic_score": ' || value || '}', '"holistic_score"\s*:\s*"?(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS score FROM events""")
def f13(spark, d):
    """The score in a judge's answer."""
    said = F.concat(F.lit('{"holistic_score": '), F.col("value").cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", text.judged_score(said).alias("score"))


@query("F14_affixes", "SELECT o_orderkey, regexp_replace(regexp_replace(o_orderpriority, '^[1-2]-', ''), 'T$', '') AS name FROM orders")
def f14(spark, d):
    """Prefixes and a suffix taken off."""
    return table(spark, d, "orders").select("o_orderkey", text.without_affixes(F.col("o_orderpriority"), ["1-", "2-"], "T").alias("name"))


@query("F15_prompt_formats", "SELECT pair_id, 'Question: ' || instruction || chr(10) || 'Answer: ' || answer AS qaform, instruction || answer AS anscat, answer AS ansonly FROM (SELECT DISTINCT pair_id, instruction, answer FROM instruct_pairs)")
def f15(spark, d):
    """Three ways to join a query and a response."""
    q, r = F.col("instruction"), F.col("answer")
    return table(spark, d, "instruct_pairs").dropDuplicates(["pair_id"]).select("pair_id", *[f(q, r).alias(n) for n, f in prompts.FORMATS.items()])


@query("F16_judge_prompt", "SELECT gen_id, 'Condition: ' || coalesce(input_text, '') || ' Text: ' || coalesce(generated_text, '') AS prompt FROM (SELECT DISTINCT gen_id, input_text, generated_text FROM generated_conditional)")
def f16(spark, d):
    """A judge's prompt from condition and response."""
    return table(spark, d, "generated_conditional").dropDuplicates(["gen_id"]).select("gen_id", prompts.judge_prompt("Condition: {condition} Text: {response}", F.col("input_text"), F.col("generated_text")).alias("prompt"))


@query("F20_contains_pattern", "SELECT doc_id, coalesce(regexp_matches(title, '(?i)switch|axis'), false) AS hit FROM documents")
def f20(spark, d):
    """A pattern in a text; null is no hit."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("title").rlike("(?i)switch|axis"), F.lit(False)).alias("hit"))


@query("F21_examples_block", "SELECT feature_name, string_agg('Example ' || (option_idx + 1) || ':' || chr(10) || option_text, chr(10) || chr(10) ORDER BY option_idx) AS block FROM feature_domain GROUP BY 1")
def f21(spark, d):
    """Numbered examples in one text."""
    by = table(spark, d, "feature_domain").groupBy("feature_name").agg(F.array_sort(F.collect_list(F.struct("option_idx", "option_text"))).alias("o"))
    return by.select("feature_name", text.examples_block(F.transform("o", lambda x: x["option_text"])).alias("block"))


@query("F23_newest_checkpoint", "SELECT max(o_orderkey % 977)::INT AS epoch FROM orders")
def f23(spark, d):
    """The largest checkpoint number among paths."""
    path = F.concat(F.lit("/runs/a/checkpoint"), (F.col("o_orderkey") % 977).cast("string"), F.lit("/model.bin"))
    return files.newest_checkpoint(table(spark, d, "orders").select(path.alias("path")))


@query("F24_mathematics", "SELECT l_orderkey, l_linenumber, exp(l_discount) AS e, ln(l_quantity + 1) AS l, sqrt(l_extendedprice) AS r, ceil(l_tax * 10)::BIGINT AS c, floor(l_tax * 10)::BIGINT AS f, abs(l_discount - 0.05) AS a FROM lineitem")
def f24(spark, d):
    """Exponentials, logarithms, roots and rounding."""
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.exp("l_discount").alias("e"), F.log1p("l_quantity").alias("l"), F.sqrt("l_extendedprice").alias("r"), F.ceil(c("l_tax") * 10).alias("c"), F.floor(c("l_tax") * 10).alias("f"), F.abs(c("l_discount") - 0.05).alias("a"))


@query("F25_linspace", "SELECT i::INT AS i, 1e-6 + i * (((1e0 - 1e-6) - 1e-6) / 24e0) AS x FROM (SELECT unnest(range(25)) AS i)")
def f25(spark, d):
    """Evenly spaced numbers."""
    return spark.range(1).select(F.posexplode(text.linspace(1e-6, 1 - 1e-6, 25)).alias("i", "x"))


@query("F22_row_to_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"note\":null}' AS generated_text FROM nation")
def f22(spark, d):
    """Rows as JSON texts with their nulls."""
    return files.record_json(table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("note")))


@query("F29_structure_score", "SELECT event_id, round(1 + 0.1 * (list_contains(json_keys(props), 'k')::INT - len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'title'))) - (2 - list_contains(json_keys(props), 'k')::INT - list_contains(json_keys(props), 'title')::INT)), 4) AS score FROM events")
def f29(spark, d):
    """Structural score of JSON texts against expected keys."""
    return table(spark, d, "events").select("event_id", text.structure_score(F.col("props"), ["k", "title"]).alias("score"))


@query("F30_matching_keys", "SELECT record_id, count(*) FILTER (a.v = b.v) AS same FROM (SELECT DISTINCT record_id, map_sample_size s, map_research_goal g, map_disease_mention m FROM parsed_features_real) r, LATERAL (SELECT unnest([s, g, m]) AS v, unnest(['s', 'g', 'm']) AS k) a, LATERAL (SELECT unnest(['One subject', 'Build a tool', 'Dementia']) AS v, unnest(['s', 'g', 'm']) AS k) b WHERE a.k = b.k GROUP BY 1")
def f30(spark, d):
    """Equal keys of a condition and a judged record."""
    got = F.create_map(F.lit("s"), F.col("map_sample_size"), F.lit("g"), F.col("map_research_goal"), F.lit("m"), F.col("map_disease_mention"))
    asked = F.create_map(*[F.lit(x) for x in ("s", "One subject", "g", "Build a tool", "m", "Dementia")])
    return table(spark, d, "parsed_features_real").dropDuplicates(["record_id"]).select("record_id", text.matching_keys(asked, got).cast("bigint").alias("same"))


@query("F31_rounding", "SELECT p_partkey, round(p_retailprice, 1) AS price FROM part")
def f31(spark, d):
    """Rounded columns."""
    return table(spark, d, "part").select("p_partkey", F.round("p_retailprice", 1).alias("price"))


@query("P10_predicate_counts", "SELECT count(*) FILTER (o_orderpriority = '5-LOW') AS exact, count(*) FILTER (contains(lower(o_orderpriority), 'low')) AS named FROM orders")
def p10(spark, d):
    """Equality and substring counts."""
    c = F.col("o_orderpriority")
    return table(spark, d, "orders").agg(F.count_if(c == "5-LOW").alias("exact"), F.count_if(F.contains(F.lower(c), F.lit("low"))).alias("named"))


# prompts


@query("P16_fixed_instruction", "SELECT 'Write a text.' AS instruction, text AS answer FROM documents")
def p16(spark, d):
    """One instruction for all rows."""
    return prompts.pairs(table(spark, d, "documents"), Recipe("parquet", "fixed", "text", 0))


@query("P17_column_instruction", "SELECT 'Features: ' || coalesce(category, '') AS instruction, text AS answer FROM documents")
def p17(spark, d):
    """An instruction around a feature column."""
    return prompts.pairs(table(spark, d, "documents"), Recipe("parquet", "column", "text", 0, "category", template="Features: {feature}"))


@query("P18_joined_answer", "SELECT 'Write a text.' AS instruction, 'SUMMARY: ' || title || chr(10) || 'EMAIL: ' || text AS answer FROM documents")
def p18(spark, d):
    """An answer of two columns."""
    return prompts.pairs(table(spark, d, "documents"), Recipe("parquet", "joined", "text", 0, "title", ("SUMMARY", "EMAIL")))


@query("P19_json_instruction", "SELECT 'Number ' || (props ->> '$.k') || '.' AS instruction, event_type AS answer FROM events")
def p19(spark, d):
    """An instruction filled from JSON keys."""
    return prompts.pairs(table(spark, d, "events"), Recipe("parquet", "json", "event_type", 0, "props", ("k",), "Number {k}."))


@query("P21_split_names", "SELECT split, CASE WHEN split = 'train' THEN 'train' WHEN split IN ('validation', 'valid', 'val') THEN 'validation' ELSE 'test' END AS part, count(*) AS rows FROM documents WHERE split IS NOT NULL GROUP BY ALL")
def p21(spark, d):
    """Split names brought to three."""
    return table(spark, d, "documents").dropna(subset=["split"]).groupBy("split", prompts.split_of(F.col("split")).alias("part")).agg(F.count(F.lit(1)).alias("rows"))


# token rows


@query("X04_training_rows")
def x04(spark, d):
    """Token lists with masked instructions."""
    return tokenised.training_rows(table(spark, d, "instruct_pairs").dropDuplicates(["pair_id"]).select("pair_id", "instruction", "answer"), "instruction", "answer").drop("instruction", "answer")


@query("A12_counted_tokens", rf"SELECT pair_id, least(512, len(regexp_extract_all(coalesce(answer, ''), '{tokenised.PATTERN}'))) + 1 AS counted FROM (SELECT DISTINCT pair_id, answer FROM instruct_pairs)")
def a12(spark, d):
    """Labels that count, of each answer."""
    rows = tokenised.training_rows(table(spark, d, "instruct_pairs").dropDuplicates(["pair_id"]), "instruction", "answer")
    return rows.select("pair_id", F.size(F.filter("labels", lambda x: x != tokenised.IGNORED)).cast("bigint").alias("counted"))


def _tokens_sql(column: str, most: int) -> str:
    return f"least({most}, len(regexp_extract_all(coalesce({column}, ''), '{tokenised.PATTERN}')))"



@query("X06_padded_batches", f"WITH n AS (SELECT pair_id, {_tokens_sql('instruction', 300)} + {_tokens_sql('answer', 512)} + 1 AS n FROM (SELECT DISTINCT pair_id, instruction, answer FROM instruct_pairs)) SELECT pair_id // 32 AS batch, count(*) AS rows, max(n)::INT AS width, max(n)::INT AS narrowest FROM n GROUP BY 1")
def x06(spark, d):
    """Batches padded on the left to their longest row."""
    rows = tokenised.training_rows(table(spark, d, "instruct_pairs").dropDuplicates(["pair_id"]).select("pair_id", "instruction", "answer"), "instruction", "answer")
    return tokenised.collate(rows.drop("instruction", "answer").withColumn("batch", F.floor(F.col("pair_id") / 32)), "batch", left=True).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("input_ids")).alias("width"), F.min(F.size("input_ids")).alias("narrowest"))


@query("O01_by_length", "SELECT doc_id, length(coalesce(text, '')) AS n FROM documents ORDER BY 2, 1")
def o01(spark, d):
    """Rows by length, so that batches pad little."""
    return table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n")).orderBy("n", "doc_id")


@query("O08_last_option", "SELECT feature_name, last(option_text ORDER BY option_idx) AS last FROM feature_domain GROUP BY 1")
def o08(spark, d):
    """The last option of each list."""
    return table(spark, d, "feature_domain").groupBy("feature_name").agg(F.max_by("option_text", "option_idx").alias("last"))


@query("X02_annotation_service", """SELECT doc_id, '{"organism": "' || CASE WHEN contains(lower(coalesce(text, '')), 'mice') THEN 'House mouse' WHEN contains(lower(coalesce(text, '')), 'yeast') THEN 'Fission yeast' ELSE 'Other' END || '", "goal": "' || CASE WHEN contains(lower(coalesce(text, '')), 'we propose') THEN 'Explain a mechanism' ELSE 'Other' END || '"}' AS inferred_schema FROM documents""")
def x02(spark, d):
    """Features of documents from a pluggable client, as an inferred column."""
    service = services.text_service(lambda: services.rule_features({"organism": [("mice", "House mouse"), ("yeast", "Fission yeast")], "goal": [("we propose", "Explain a mechanism")]}))
    return table(spark, d, "documents").select("doc_id", service("text").alias("inferred_schema"))


@query("X09_conditional_generation")
def x09(spark, d):
    """Texts for prompts, from a pluggable generator."""
    chain = {"": ["The", "These"], "The": ["cells"], "These": ["genes"], "cells": ["grow."], "genes": ["act."]}
    service = services.text_service(lambda: services.word_chain(chain, 12), failed=None)
    return table(spark, d, "generated_conditional").dropDuplicates(["gen_id"]).select("gen_id", F.col("input_text"), service("input_text").alias("generated_text"))


@query("E12_embeddings")
def e12(spark, d):
    """Unit vectors of documents from a pluggable encoder."""
    return table(spark, d, "documents").select("doc_id", services.hashed_embedding(32)("text").alias("embedding"))


# sources and sinks: written to the shared folder and read again


def _there_and_back(spark, df: DataFrame, kind: str) -> DataFrame:
    path = f"{work_dir(spark)}/sink-{uuid.uuid4().hex}.{kind}"
    if kind == "csv":
        files.write_csv(df, path)
    elif kind == "jsonl":
        files.write_jsonl(df, path)
    else:
        df.write.format(kind).save(path)
    return files.read_table(spark, path)


@query("S01_csv_round_trip", "SELECT doc_id, lang, title, text FROM documents")
def s01(spark, d):
    """Written as CSV and read again: quotes, separators, line breaks and whole texts survive."""
    df = table(spark, d, "documents").select("doc_id", "lang", "title", "text")
    return _there_and_back(spark, df, "csv").select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "title", "text")


@query("S02_jsonl_round_trip", "SELECT pair_id, instruction, answer FROM instruct_pairs")
def s02(spark, d):
    """Written as JSON lines and read again."""
    return _there_and_back(spark, table(spark, d, "instruct_pairs").select("pair_id", "instruction", "answer"), "jsonl").select("pair_id", "instruction", "answer")


@query("S06_columnar_round_trip", "SELECT vec_id, label, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def s06(spark, d):
    """Arrays written in columns and read again."""
    back = _there_and_back(spark, table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "orc")
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "label", F.size("embedding").alias("width"), F.round(total, 4).alias("total"))


@query("S10_mixed_splits", "SELECT 'train' AS split, count(*) AS rows, count(lang) AS langs FROM documents WHERE split = 'train' UNION ALL SELECT 'validation', count(*), 0 FROM documents WHERE split <> 'train'")
def s10(spark, d):
    """Splits from files of two kinds with different columns."""
    df, root = table(spark, d, "documents"), f"{work_dir(spark)}/mixed-{uuid.uuid4().hex}"
    files.write_csv(df.filter("split = 'train'").select("text", "lang"), f"{root}/a.csv")
    files.write_jsonl(df.filter("split <> 'train'").select("text"), f"{root}/b.jsonl")
    both = files.read_splits(spark, {"train": f"{root}/a.csv", "validation": f"{root}/b.jsonl"})
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count("lang").alias("langs"))


@query("S11_constant_prompts", "SELECT range AS id, 'Write a text.' AS query FROM range(1000)")
def s11(spark, d):
    """Copies of a prompt."""
    return files.constant_prompts(spark, "Write a text.", 1000)


@query("S12_prompt_tokens", rf"SELECT pair_id, least(256, len(regexp_extract_all(instruction, '{tokenised.PATTERN}'))) AS n FROM (SELECT DISTINCT pair_id, instruction FROM instruct_pairs)")
def s12(spark, d):
    """Prompts as token lists cut to a limit."""
    return tokenised.prompt_rows(table(spark, d, "instruct_pairs").dropDuplicates(["pair_id"]), "instruction").select("pair_id", F.size("input_ids").cast("bigint").alias("n"))


@query("K06_resumed_append", "SELECT count(*) AS rows, count(DISTINCT gen_id) AS keys FROM (SELECT DISTINCT gen_id FROM generated_conditional)")
def k06(spark, d):
    """An append that was interrupted and goes on: each key once."""
    path = f"{work_dir(spark)}/resume-{uuid.uuid4().hex}"
    df = table(spark, d, "generated_conditional").dropDuplicates(["gen_id"]).select("gen_id", "generated_text")
    files.append_missing(df.filter("gen_id % 3 = 0"), path, "gen_id")
    files.append_missing(df, path, "gen_id")
    return spark.read.json(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("gen_id").alias("keys"))


@query("K02_labelled_report", "SELECT 'quality' AS metric, avg(quality) AS value FROM domain_labels UNION ALL SELECT 'flagged', avg(flagged) FROM domain_labels")
def k02(spark, d):
    """A report with its row label as a column."""
    return table(spark, d, "domain_labels").agg(F.avg("quality").alias("quality"), F.avg("flagged").alias("flagged")).unpivot([], ["quality", "flagged"], "metric", "value")


@query("P25_rows_to_lists", "SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS numbers FROM lineitem GROUP BY 1")
def p25(spark, d):
    """Rows of a batch as lists."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("numbers"))


@query("O05_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS top FROM embeddings")
def o05(spark, d):
    """The position of the largest entry."""
    return table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("top"))


@query("W06_positions", "SELECT feature_name, option_text, (row_number() OVER (PARTITION BY feature_name ORDER BY option_idx) - 1)::INT AS position FROM feature_domain")
def w06(spark, d):
    """Positions within an order."""
    return table(spark, d, "feature_domain").select("feature_name", "option_text", (F.row_number().over(W.partitionBy("feature_name").orderBy("option_idx")) - 1).alias("position"))
