"""Seeded sampling, splits, batches and label codes that do not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.marginals import keyed_uniform


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if there are fewer): those with the lowest keyed hashes. The result is the sample."""
    return df.withColumn("_u", keyed_uniform(F.col(key), seed=seed)).orderBy("_u", key).limit(n).drop("_u")


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: within each label, ``share`` of the rows are ``validation``.

    The rank that divides a label is found from per-bucket counts of the hash, so a label that holds most rows is not
    sorted in one task: only the bucket with the boundary is ranked.
    """
    buckets = 4096
    rows = df.withColumn("_u", keyed_uniform(F.col(key), seed=seed)).withColumn("_b", F.floor(F.col("_u") * buckets))
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(W.partitionBy(label)))
    ranked = rows.join(before.drop("_c"), [label, "_b"]).withColumn("_k", F.col("_before") + F.row_number().over(W.partitionBy(label, "_b").orderBy("_u", key)))
    split = F.when(F.col("_k") <= F.round(share * F.col("_n")), "validation").otherwise("train")
    return ranked.select(*[F.col(c) for c in df.columns], split.alias("split"))


def ordered_index(df: DataFrame, order: Sequence[str], name: str = "k", buckets: int = 4096) -> DataFrame:
    """``df`` with a gapless index from 0 in the order of a column ``_u`` in (0, 1), without a single-task sort."""
    rows = df.withColumn("_b", F.floor(F.col("_u") * buckets))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # at most ``buckets`` rows meet in this window
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(W.partitionBy())).drop("_c")
    return rows.join(before, "_b").withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_u", *order)) - 1).drop("_b", "_before")


def shuffled_batches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """(columns, batch): a seeded shuffle cut into full batches; an incomplete last batch is dropped."""
    rows = ordered_index(df.withColumn("_u", keyed_uniform(F.col(key), seed=seed)), [key], "_k")
    batch = F.floor(F.col("_k") / size)
    return rows.filter(batch < F.floor(F.col("_n") / size)).select(*df.columns, batch.alias("batch"))


def poisson_batches(df: DataFrame, key: str, steps: int, rate: float, seed: int = 42) -> DataFrame:
    """(step, columns): each row enters each step's batch independently with probability ``rate``.

    For private training pass a secret ``seed``: whoever knows seed and keys knows the batches.
    """
    each = df.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint"))))
    return each.filter(keyed_uniform(F.col(key), F.col("step"), seed=seed) < rate)


def replicate(df: DataFrame, times: str, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0; rows of zero, negative or null times vanish."""
    return df.filter(F.col(times) > 0).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code): distinct labels in alphabetical order; nulls have no code. Labels are few by nature."""
    labels = df.select(label).dropna().distinct()
    return labels.withColumn("code", F.row_number().over(W.orderBy(label)) - 1)


def fuzzy_fields(names: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_name, column_name): for each name the first column that contains it or lies in it. Metadata only."""
    plain = lambda c: F.translate(F.lower(c), "_", " ")
    other = F.explode(F.array(*[F.lit(c) for c in sorted(columns)]))
    met = names.withColumn("column_name", other).filter(F.contains(plain(F.col("feature_name")), plain(F.col("column_name"))) | F.contains(plain(F.col("column_name")), plain(F.col("feature_name"))))
    return met.groupBy("feature_name").agg(F.min("column_name").alias("column_name"))
