"""Queries of the record loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.operators.ingest import domain_options, failure_report, split_load
from marginalia.plans.catalogue import Catalogue, table

CATALOGUE = Catalogue()


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return split_load(table(spark, d, "synthetic_features"), "row_id", "generated_text", domain_options(table(spark, d, "feature_domain")))


_BODY = r"""
WITH raw AS (SELECT DISTINCT row_id, run_id, regexp_replace(regexp_replace(generated_text, '^\s+', ''), '\s+$', '') AS t FROM synthetic_features),
bodies AS (SELECT row_id, run_id, CASE WHEN regexp_full_match(t, '(?s)```(json)?.*```') AND length(t) >= 6
  THEN regexp_replace(regexp_replace(regexp_replace(t, '^```(json)?\s*', ''), '```$', ''), '\s+$', '') ELSE t END AS b FROM raw),
strict AS (SELECT row_id, run_id, b, json_valid(b) AND left(b, 1) = '{' AND NOT regexp_matches(b, ',\s*[}\]]') AND NOT regexp_matches(b, '(NaN|Infinity)') AS ok FROM bodies),
members AS (SELECT row_id, unnest(json_keys(b)) AS k, unnest(json_extract(b, '$.*')) AS v FROM strict WHERE ok),
judged AS (SELECT m.row_id, count(*) AS n, count(DISTINCT k) FILTER (k IN (SELECT feature_name FROM feature_domain)) AS known,
  count(*) FILTER (json_type(v) = 'VARCHAR' AND d.option_text IS NOT NULL) AS fit
  FROM members m LEFT JOIN feature_domain d ON d.feature_name = m.k AND d.option_text = m.v ->> '$' GROUP BY 1),
reasons AS (SELECT s.row_id, s.run_id, s.b, CASE WHEN NOT coalesce(s.ok, false) THEN 'syntax' WHEN coalesce(j.n, 0) <> 8 OR j.known <> 8 THEN 'columns'
  WHEN j.fit <> 8 THEN 'values' END AS reason FROM strict s LEFT JOIN judged j USING (row_id))
"""


@CATALOGUE.query("p1_found", _BODY + "SELECT row_id, reason FROM reasons WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that do not load, with the reason."""
    return _split(spark, d)[1]


_COLUMNS = ", ".join(f"b ->> '$.{n}' AS {n}" for n in ("disease_mention", "dominant_data_type", "experimental_approach", "model_organism", "primary_research_area", "research_focus_scale", "research_goal", "sample_size"))


def p1_loaded_sql() -> str:
    return _BODY + f"SELECT row_id, {_COLUMNS} FROM reasons WHERE reason IS NULL"


@CATALOGUE.query("p1_loaded", p1_loaded_sql())
def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Records that load, as eight feature columns."""
    return _split(spark, d)[0]


@CATALOGUE.query("p1_report", _BODY + "SELECT run_id, reason, count(*) AS records FROM reasons WHERE reason IS NOT NULL GROUP BY ALL")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Failed records per run and reason."""
    return failure_report(_split(spark, d)[1], table(spark, d, "synthetic_features"), "row_id", ["run_id"])
