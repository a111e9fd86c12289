"""Occurrences and record frequencies of every distinct value and term of chosen columns.

Vertical layout: each value holds a bitmap of the records that have it, cut into 64-bit words, and only words with a
record in them exist. A word is a plain long, so bitmaps are built and united by ``bit_or`` inside the hash
aggregation, on the map side first. Redelivered records set bits that are already set. Terms inherit the united words
of the values they stand in; record frequency is the cardinality of a term's words, and occurrences are counted beside.
A term that stands in a third of all records is spread over as many groups as its bitmap has words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java pattern of a term: a maximal run of Unicode letters and digits.
TERM = r"[\p{L}\p{Nd}]+"
#: Java pattern of a value without any character but white space.
BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*\z"


def value_bitmaps(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(feature_name, value, word, bits): which records hold which value; null and blank values are left out.

    Record k is bit ``k mod 64`` of word ``k div 64``; records without a key count as one record, in a word of its own.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    rows = df.select(F.col(key).cast("long").alias("_key"), pairs.alias("_p")).select("_key", "_p.*")
    rows = rows.filter(F.col("value").isNotNull() & ~F.col("value").rlike(BLANK))
    bit = F.expr("shiftleft(1L, cast(coalesce(_key, 0) & 63 as int))")
    return rows.groupBy("feature_name", "value", F.shiftright("_key", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _cardinality() -> Column:
    return F.bit_count("bits").cast("long")


def value_counts(bitmaps: DataFrame) -> DataFrame:
    """(feature_name, value, records) of every distinct value, as written."""
    return bitmaps.groupBy("feature_name", "value").agg(F.sum(_cardinality()).alias("records"))


def term_counts(bitmaps: DataFrame) -> DataFrame:
    """(feature_name, term, occurrences, records) of every term of the lower-cased values."""
    terms = bitmaps.select("feature_name", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(TERM), F.lit(0))).alias("term"), "word", "bits")
    words = terms.groupBy("feature_name", "term", "word").agg(F.bit_or("bits").alias("bits"), F.sum(_cardinality()).alias("occurrences"))
    return words.groupBy("feature_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum(_cardinality()).alias("records"))


def term_verdicts(df: DataFrame, key: str, columns: Sequence[str], rare_max: int = 2, common_share: float = 0.1) -> DataFrame:
    """(feature_name, term, occurrences, records, filled, verdict) of every term.

    ``filled`` is the number of records whose value is neither null nor blank. ``verdict`` is ``common`` above
    ``common_share`` of them, else ``rare`` up to ``rare_max`` records, else ``useful``. An empty input, or one of
    nulls and blanks, gives no rows; values of any length are taken whole.
    """
    bitmaps = value_bitmaps(df, key, columns)
    filled = value_counts(bitmaps).groupBy("feature_name").agg(F.sum("records").alias("filled"))
    verdict = F.when(F.col("records") > common_share * F.col("filled"), "common").when(F.col("records") <= rare_max, "rare").otherwise("useful")
    return term_counts(bitmaps).join(filled, "feature_name").withColumn("verdict", verdict)
