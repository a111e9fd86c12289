"""Differentially private gradient descent on a softmax model: clipping, accumulation and noise as aggregates."""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.aim import Noise, SystemNoise
from marginalia.operators.marginals import keyed_uniform


def clipped(gradient: Column, norm: float) -> Column:
    """A gradient array scaled down to at most ``norm``."""
    size = gradient_norm(gradient)
    return F.transform(gradient, lambda x: x * F.least(F.lit(1.0), F.lit(norm) / F.greatest(size, F.lit(1e-12))))


def gradient_norm(gradient: Column) -> Column:
    return F.sqrt(F.aggregate(gradient.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def summed_gradients(df: DataFrame, features: str, label: str, weights: np.ndarray, clip: float) -> tuple[np.ndarray, int, float]:
    """(sum of clipped per-example gradients, examples, loss): one partial sum per task, added by a tree of tasks."""
    shape = weights.shape
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total, count, loss = np.zeros(shape), 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            z = x @ w
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
            p[np.arange(len(y)), y] -= 1
            # the norm of an outer product is the product of the norms
            norms = np.linalg.norm(x, axis=1) * np.linalg.norm(p, axis=1)
            scale = np.minimum(1, clip / np.maximum(norms, 1e-12))
            total += x.T @ (p * scale[:, None])
            count += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([count], pa.int64()), pa.array([loss], pa.float64())], names=["g", "n", "l"])

    parts = df.select(features, label).mapInArrow(partial, "g binary, n long, l double")
    g, n, loss = parts.rdd.map(lambda r: (np.frombuffer(r.g), r.n, r.l)).treeAggregate((np.zeros(int(np.prod(shape))), 0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    return g.reshape(shape), n, loss


def train(df: DataFrame, key: str, features: str, label: str, width: int, classes: int, rate: float, steps: int, sigma: float, clip: float = 1.0, learning_rate: float = 1.0, noise: Noise | None = None, seed: int | None = None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(weights, [(step, examples, loss)]): Poisson-sampled steps, noise added once to the summed clipped gradients.

    The divisor is the expected batch, not the drawn one, so it reveals nothing. Accounting by subsampling holds only while
    nobody knows which rows a step drew: without ``seed`` a secret one is drawn; a given seed is for tests.
    """
    seed = secrets.randbits(62) if seed is None else seed
    noise = noise or SystemNoise()
    weights = np.zeros((width, classes))
    batch = max(1.0, rate * df.count())
    log = []
    for step in range(steps):
        drawn = df.filter(keyed_uniform(F.col(key), F.lit(step), seed=seed) < rate)
        g, n, loss = summed_gradients(drawn, features, label, weights, clip)
        g += noise.normal(clip * sigma, g.size).reshape(g.shape) if sigma > 0 else 0
        weights = weights - learning_rate * g / batch
        log.append((step, n, loss / max(n, 1)))
    return weights, log
