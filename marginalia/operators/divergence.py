"""Distances between the value distributions of a real and a synthetic table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entries(df: DataFrame, side: str, columns: Sequence[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("e")).select("e.*", F.lit(side).alias("side"))


def _pair_entries(df: DataFrame, side: str, columns: Sequence[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}*{b}").alias("metric"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(columns, 2)]))
    return df.select(each.alias("e")).select("e.*", F.lit(side).alias("side"))


def _distances(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """From (by, n_real, n_synth, all_real, all_synth) rows: total variation over all rows, and JS distance of the
    renormalised distributions in natural logarithms."""
    p, q = F.col("n_real") / F.col("all_real"), F.col("n_synth") / F.col("all_synth")
    rp, rq = F.col("n_real") / F.col("have_real"), F.col("n_synth") / F.col("have_synth")
    m = (rp + rq) / 2
    term = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return counts.groupBy(*by).agg(
        (F.sum(F.abs(p - q)) / 2).alias("tvd"),
        F.sqrt(F.greatest(F.sum(term(rp) + term(rq)) / 2, F.lit(0.0))).alias("jsd"),
        F.count_if(F.col("n_real") > 0).alias("unique_real"),
        F.count_if(F.col("n_synth") > 0).alias("unique_synth"),
    )


def category_counts(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value, n_real, n_synth): both histograms of each column, aligned, missing values as zeros."""
    rows = _entries(real, "real", columns).unionByName(_entries(synthetic, "synth", columns))
    return rows.groupBy("metric", "value").agg(F.count_if(F.col("side") == "real").alias("n_real"), F.count_if(F.col("side") == "synth").alias("n_synth"))


def category_divergence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, tvd, jsd, unique_real, unique_synth) of each column.

    Nulls are no category, but count in the denominator of the total variation. One scan of either table.
    """
    counts = category_counts(real, synthetic, columns)
    totals = counts.groupBy("metric").agg(F.sum("n_real").alias("all_real"), F.sum("n_synth").alias("all_synth"), F.sum(F.when(F.col("value").isNotNull(), F.col("n_real"))).alias("have_real"), F.sum(F.when(F.col("value").isNotNull(), F.col("n_synth"))).alias("have_synth"))
    return _distances(counts.filter(F.col("value").isNotNull()).join(F.broadcast(totals), "metric"), ["metric"])  # totals: one row a column


def pair_divergence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], fill: str = "NA (added)") -> DataFrame:
    """(metric, tvd, jsd, ...) of each pair of columns; only the synthetic side has its nulls filled, and a pair with a
    null stays a category."""
    rows = _pair_entries(real, "real", columns).unionByName(_pair_entries(synthetic.fillna(fill, list(columns)), "synth", columns))
    counts = rows.groupBy("metric", "x", "y").agg(F.count_if(F.col("side") == "real").alias("n_real"), F.count_if(F.col("side") == "synth").alias("n_synth"))
    totals = counts.groupBy("metric").agg(F.sum("n_real").alias("all_real"), F.sum("n_synth").alias("all_synth"))
    totals = totals.withColumn("have_real", F.col("all_real")).withColumn("have_synth", F.col("all_synth"))
    return _distances(counts.join(F.broadcast(totals), "metric"), ["metric"])  # totals: one row a pair of columns


def mean_pair_divergence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(tvd, jsd): plain means over all pairs of columns."""
    return pair_divergence(real, synthetic, columns).agg(F.avg("tvd").alias("tvd"), F.avg("jsd").alias("jsd"))


def divergence_report(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The one-way rows and a last row ``2way``; columns that either table lacks are left out."""
    common = [c for c in columns if c in real.columns and c in synthetic.columns]
    one = category_divergence(real, synthetic, common)
    two = mean_pair_divergence(real, synthetic, common).select(F.lit("2way").alias("metric"), "tvd", "jsd", F.lit(None).cast("bigint").alias("unique_real"), F.lit(None).cast("bigint").alias("unique_synth"))
    return one.unionByName(two)


def last_option_shares(df: DataFrame, options: dict[str, list[str]]) -> DataFrame:
    """(feature, rows, hits, percent): rows that took a feature's last option, or else name it in words."""

    def hits(c: str, last: str) -> Column:
        exact = F.count_if(F.col(c) == last)
        return F.when(exact > 0, exact).otherwise(F.count_if(F.coalesce(F.lower(c).rlike("other|not applicable"), F.lit(False))))

    parts = df.agg(F.count(F.lit(1)).alias("_n"), *[hits(c, o[-1]).alias(c) for c, o in options.items()])
    wide = parts.unpivot("_n", list(options), "feature", "hits")
    return wide.select("feature", F.col("_n").alias("rows"), "hits", (100.0 * F.col("hits") / F.col("_n")).alias("percent"))
