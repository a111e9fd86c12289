"""Marginal counts of coded tables: one scan for all cliques, dense spines, noise, compression."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Clique = tuple[str, ...]
#: Cells of one clique that may go to the driver.
MAX_CELLS = 4_000_000


def closure(cliques: Iterable[Clique]) -> list[Clique]:
    """All non-empty subsets of the cliques, shorter ones first."""
    found = {sub for c in cliques for k in range(1, len(c) + 1) for sub in combinations(c, k)}
    return sorted(found, key=lambda c: (len(c), c))


def workload_weights(workload: Mapping[Clique, float]) -> dict[Clique, float]:
    """Weight of each subset: over all workload cliques, their weight times the columns in common."""
    return {c: sum(w * len(set(c) & set(q)) for q, w in workload.items()) for c in closure(workload)}


def default_workload(sizes: Mapping[str, int], ways: int = 3, limit: float = 1e6) -> dict[Clique, float]:
    """All cliques of ``ways`` columns (or of all, if there are fewer) whose cells do not exceed ``limit``."""
    ways = min(ways, len(sizes))
    return {c: 1.0 for c in combinations(sizes, ways) if np.prod([float(sizes[x]) for x in c]) <= limit}


def marginal_counts(df: DataFrame, cliques: Sequence[Clique]) -> DataFrame:
    """(clique, cell, n) of all cliques in one scan.

    Rows are first reduced to distinct full-width combinations, so the expansion over grouping sets multiplies those
    and not the rows. ``cell`` holds the values of the clique's columns as text, in the clique's order.
    """
    columns = sorted({c for q in cliques for c in q})
    wide = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    if len(cliques) == 1:
        grouped = wide.groupBy(*cliques[0]).agg(F.sum("_n").alias("n")).withColumn("_id", F.lit(0))
        ids = {cliques[0]: 0}
    else:
        grouped = wide.groupingSets([[F.col(c) for c in q] for q in cliques], *[F.col(c) for c in columns]).agg(F.sum("_n").alias("n"), F.grouping_id().alias("_id"))
        ids = {q: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in q) for q in cliques}
    if len(set(ids.values())) != len(ids):
        raise ValueError("two cliques have the same columns")
    name = F.coalesce(*[F.when(F.col("_id") == i, F.lit(",".join(q))) for q, i in ids.items()])
    cell = F.coalesce(*[F.when(F.col("_id") == i, F.array(*[F.col(c).cast("string") for c in q])) for q, i in ids.items()])
    return grouped.select(name.alias("clique"), cell.alias("cell"), F.col("n").cast("bigint").alias("n"))


def dense(df: DataFrame, clique: Clique, sizes: Mapping[str, int]) -> DataFrame:
    """(codes of the clique, n) for every cell of the domain, zeros included."""
    spine = None
    for c in clique:
        codes = df.sparkSession.range(sizes[c]).select(F.col("id").cast("int").alias(c))
        spine = codes if spine is None else spine.crossJoin(codes)  # the domain's cells, not data
    counts = df.groupBy(*clique).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, list(clique), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def vectors(df: DataFrame, cliques: Sequence[Clique], sizes: Mapping[str, int]) -> dict[Clique, np.ndarray]:
    """Dense count tensors on the driver, of the checked size of the domain, from one scan."""
    out = {q: np.zeros([sizes[c] for c in q]) for q in cliques}
    for q, x in out.items():
        if x.size > MAX_CELLS:
            raise ValueError(f"clique {q} has {x.size} cells; at most {MAX_CELLS} go to the driver")
    names = {",".join(q): q for q in cliques}
    places = [F.when(F.col("clique") == name, cell_index([F.element_at("cell", i + 1).cast("long") for i in range(len(q))], [sizes[c] for c in q])) for name, q in names.items()]
    found = marginal_counts(df, cliques).select("clique", F.coalesce(*places).alias("at"), "n").toArrow()  # at most the cells above
    clique, at, n = (found.column(i).to_numpy() for i in range(3))
    for name, q in names.items():
        own = clique == name
        out[q].ravel()[at[own].astype(np.int64)] = n[own]
    return out


def cell_index(codes: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Place of a cell in the dense tensor of a clique, in order of its last code first."""
    at = F.lit(0).cast("long")
    for code, size in zip(codes, sizes):
        at = at * size + code
    return at


def keyed_uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from a keyed hash: the same after any repartitioning. Not a secure source of noise."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def keyed_normal(*keys: Column, seed: int = 0) -> Column:
    """A standard normal number from two keyed uniforms."""
    u, v = keyed_uniform(*keys, seed=seed), keyed_uniform(*keys, F.lit("v"), seed=seed)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def measure(counts: DataFrame, sigma: float, weights: Mapping[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``counts`` (clique, cell, n) with the Gaussian mechanism's ``noisy`` and ``stddev``.

    Weights are scaled to length 1 and divide sigma; without them every clique is measured at sigma.
    """
    stddev = F.lit(float(sigma))
    if weights:
        length = float(np.sqrt(sum(w * w for w in weights.values())))
        stddev = F.coalesce(*[F.when(F.col("clique") == q, F.lit(sigma * length / w)) for q, w in weights.items()])
    key = F.concat_ws(",", F.col("clique"), F.array_join("cell", ","))
    return counts.withColumn("stddev", stddev).withColumn("noisy", F.col("n") + F.col("stddev") * keyed_normal(key, seed=seed))


def rare_cells(measured: DataFrame, times: float = 3.0) -> DataFrame:
    """``measured`` with ``rare``: the noisy count lies below ``times`` standard deviations."""
    return measured.withColumn("rare", F.col("noisy") < times * F.col("stddev"))


def compress(measured: DataFrame, code: str = "new_code") -> DataFrame:
    """One-way measurements over merged codes: (clique, code, value, coef), the sum over its root count, and 1 / root."""
    by = measured.groupBy("clique", code).agg(F.sum("noisy").alias("_y"), F.count(F.lit(1)).alias("_k"), F.first("stddev").alias("stddev"))
    return by.select("clique", code, (F.col("_y") / F.sqrt("_k")).alias("value"), (1 / F.sqrt("_k")).alias("coef"), "stddev")


def total_estimate(measured: DataFrame) -> DataFrame:
    """The total with least variance from the sums of several measured cliques: (total, variance)."""
    sums = measured.groupBy("clique").agg(F.sum("noisy").alias("_t"), F.sum(F.col("stddev") * F.col("stddev")).alias("_v"))
    return sums.agg((F.sum(F.col("_t") / F.col("_v")) / F.sum(1 / F.col("_v"))).alias("total"), (1 / F.sum(1 / F.col("_v"))).alias("variance"))


def exponential_choice(scores: DataFrame, key: str, score: str, epsilon: float, sensitivity: float, monotonic: bool = False, seed: int = 0) -> DataFrame:
    """The exponential mechanism as a largest Gumbel-perturbed score: one row (key, score)."""
    scale = (1.0 if monotonic else 0.5) * epsilon / sensitivity
    gumbel = -F.log(-F.log(keyed_uniform(F.col(key), seed=seed)))
    return scores.agg(F.max_by(F.struct(key, score), scale * F.col(score) + gumbel).alias("_b")).select("_b.*")
