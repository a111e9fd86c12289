"""Adaptive and iterative mechanism (McKenna et al., arXiv 2201.12677): select, measure, estimate, sample.

Spark answers all candidate marginals in one scan before the loop; the rounds run on the driver.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import accounting, marginals
from marginalia.operators.encoding import Categorical, Encoding, Numerical, encode, encoder_for, merge_rare
from marginalia.operators.graphical import Clique, Measurement, Model, estimate, model_megabytes, sample_rows


class SystemNoise:
    """Normal and Gumbel noise from the operating system's secure source, for releases."""

    def _uniform(self, n: int) -> np.ndarray:
        return (np.frombuffer(os.urandom(8 * n), np.uint64) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54

    def normal(self, scale: float, n: int) -> np.ndarray:
        return scale * np.sqrt(-2 * np.log(self._uniform(n))) * np.cos(2 * math.pi * self._uniform(n))

    def gumbel(self, n: int) -> np.ndarray:
        return -np.log(-np.log(self._uniform(n)))


class SeededNoise:
    """Reproducible noise for tests."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def normal(self, scale: float, n: int) -> np.ndarray:
        return self.rng.normal(0, scale, n)

    def gumbel(self, n: int) -> np.ndarray:
        return self.rng.gumbel(size=n)


Noise = SystemNoise | SeededNoise


def measure(vectors: Mapping[Clique, np.ndarray], cliques: Sequence[Clique], sigma: float, noise: Noise, weights: Sequence[float] | None = None) -> list[Measurement]:
    """Gaussian measurements; with ``weights`` (scaled to length 1) a clique's noise is sigma over its weight."""
    w = np.ones(len(cliques)) if weights is None else np.asarray(weights, float) / np.linalg.norm(weights)
    return [Measurement(q, vectors[q].ravel() + noise.normal(sigma / x, vectors[q].size), sigma / x) for q, x in zip(cliques, w)]


def choose(scores: Sequence[float], epsilon: float, sensitivity: float, noise: Noise, monotonic: bool = False) -> int:
    """Index by the exponential mechanism (Gumbel-max)."""
    scale = (1.0 if monotonic else 0.5) * epsilon / sensitivity
    return int(np.argmax(scale * np.asarray(scores) + noise.gumbel(len(scores))))


def candidates_within(candidates: Mapping[Clique, float], model: Model, limit: float) -> dict[Clique, float]:
    """Candidates that keep the model within ``limit`` megabytes, or that it already covers."""
    free = set(marginals.closure(model.cliques))
    return {q: w for q, w in candidates.items() if tuple(sorted(q)) in {tuple(sorted(f)) for f in free} or model_megabytes(model.sizes, [*model.measured, q]) <= limit}


@dataclass
class Options:
    """``compat`` repeats known slips of common code: coefficient 1 in selection, L2 norm in annealing, weighted one-way noise."""

    max_rounds: int | None = None
    iterations: int = 1000
    model_megabytes: float = 80.0
    one_way_share: float = 0.1
    numeric_bins: int = 32
    compat: bool = False
    workload: Mapping[Clique, float] | None = None
    log: list = field(default_factory=list)


def run_rounds(vectors_of, sizes: Mapping[str, int], rho: float, noise: Noise, options: Options, initial: Sequence[Measurement] = ()) -> Model:
    """The adaptive loop. ``vectors_of(cliques)`` gives exact answers, of which only noisy or selected ones are used."""
    workload = dict(options.workload or marginals.default_workload(sizes))
    candidates = marginals.workload_weights(workload)
    answers = vectors_of(list(candidates))
    rounds = options.max_rounds or 16 * len(sizes)
    per_round, left = rho / rounds, rho
    measurements = list(initial)
    model = estimate(sizes, measurements, options.iterations)
    done = False
    while not done:
        if left < 2 * per_round:
            per_round, done = left, True
        left -= per_round
        sigma, eps = accounting.gaussian_sigma(0.9 * per_round), accounting.exponential_eps(0.1 * per_round)
        small = candidates_within(candidates, model, options.model_megabytes * (rho - left) / rho)
        if not small:
            continue
        keys = list(small)
        scores = [small[q] * (np.abs(answers[q] - model.project(q)).sum() - math.sqrt(2 / math.pi) * sigma * answers[q].size) for q in keys]
        picked = keys[choose(scores, eps, max(candidates.values()), noise, options.compat)]
        old = model.project(picked)
        measurements += measure(answers, [picked], sigma, noise)
        model = estimate(sizes, measurements, options.iterations, start=model)
        moved = model.project(picked) - old
        size = np.linalg.norm(moved) if options.compat else np.abs(moved).sum()
        options.log.append((picked, sigma, 1 - left / rho, len(small)))
        if size <= sigma * math.sqrt(2 / math.pi) * moved.size:
            per_round *= 2
    return model


def synthesize(df: DataFrame, domains: Mapping[str, Categorical | Numerical], rho: float | None = None, epsilon: float | None = None, delta: float | None = None, rows: int | None = None, noise: Noise | None = None, seed: int = 0, options: Options | None = None) -> DataFrame:
    """Synthetic rows over ``domains``: encode, measure one-way, merge rare codes, adapt, sample, decode.

    The budget is ``rho`` or follows from (epsilon, delta). Without ``rows`` the noisy total is sampled. Nulls and
    values outside a domain take its default code.
    """
    options, noise = options or Options(), noise or SystemNoise()
    if not domains:
        raise ValueError("the domain file names no column")
    rho = rho or accounting.zcdp_rho(epsilon, delta)
    encodings: dict[str, Encoding] = {c: encoder_for(d, options.numeric_bins) for c, d in domains.items()}
    # one pass over the data: everything later is a sum over these distinct coded rows
    coded = encode(df, encodings).groupBy(*encodings).agg(F.count(F.lit(1)).alias("_n")).persist()
    full = {c: e.size for c, e in encodings.items()}
    ones = [(c,) for c in encodings]
    exact = _weighted_vectors(coded, ones, full)
    sigma = accounting.gaussian_sigma(options.one_way_share * rho / len(ones))
    first = measure(exact, ones, sigma, noise, [1.0] * len(ones) if options.compat else None)
    merged, sizes, initial = {}, {}, []
    for m in first:
        c = m.clique[0]
        merged[c] = merge_rare((m.values < 3 * m.stddev))
        mapping = _mapping(m.values < 3 * m.stddev)
        count = np.bincount(mapping, minlength=merged[c].size)
        sizes[c] = merged[c].size
        initial.append(Measurement(m.clique, np.bincount(mapping, m.values, merged[c].size) / np.sqrt(count), m.stddev, 1 / np.sqrt(count)))
    totals = np.array([m.values.sum() for m in first])
    total = float(np.average(totals, weights=[1 / (m.stddev**2 * m.values.size) for m in first]))
    small = coded.select("_n", *[merged[c].forward(F.col(c)).alias(c) for c in encodings])
    model = run_rounds(lambda cliques: _weighted_vectors(small, cliques, sizes), sizes, rho * (1 - options.one_way_share), noise, options, [Measurement((), np.array([max(total, 1.0)]), 1.0), *initial])
    coded.unpersist()
    out = sample_rows(df.sparkSession, model, rows if rows is not None else max(0, int(total)), seed)
    back = {c: encodings[c].inverse(merged[c].inverse(F.col(c))).alias(c) for c in encodings}
    return out.select(*back.values())


def _mapping(rare: np.ndarray) -> np.ndarray:
    kept = np.cumsum(~rare) - 1
    return np.where(rare, (~rare).sum(), kept)


def _weighted_vectors(counted: DataFrame, cliques: Sequence[Clique], sizes: Mapping[str, int]) -> dict[Clique, np.ndarray]:
    """Count tensors of all cliques from rows with a count ``_n``, in one scan."""
    columns = sorted({c for q in cliques for c in q})
    out = {q: np.zeros([sizes[c] for c in q]) for q in cliques}
    if (cells := sum(x.size for x in out.values())) > 20 * marginals.MAX_CELLS:
        raise ValueError(f"the workload has {cells} cells; lower the limit of its cliques")
    ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in q): q for q in cliques}
    sets = [[F.col(c) for c in q] for q in cliques]
    rows = counted.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.sum("_n").alias("_n"), F.grouping_id().alias("_id"))
    place = F.coalesce(*[F.when(F.col("_id") == i, marginals.cell_index([F.col(c) for c in q], [sizes[c] for c in q])) for i, q in ids.items()])
    found = rows.select("_id", place.alias("_at"), "_n").toArrow()
    which, at, n = (found.column(i).to_numpy() for i in range(3))
    for i, q in ids.items():
        own = which == i
        out[q].ravel()[at[own]] = n[own]
    return out
