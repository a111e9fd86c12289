"""Graphical models over coded columns: junction tree, inference, estimation from noisy marginals, sampling.

The model lives on the driver and is bounded by its size in megabytes; counts come from Spark, and sampling runs there.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Clique = tuple[str, ...]


@dataclass(frozen=True)
class Measurement:
    """Noisy values of a clique; ``coef`` scales the true marginal first, if the values were compressed."""

    clique: Clique
    values: np.ndarray
    stddev: float
    coef: np.ndarray | None = None


def triangulate(sizes: Mapping[str, int], cliques: Iterable[Clique]) -> list[Clique]:
    """Maximal cliques after eliminating columns, each time the one that adds the fewest edges."""
    near: dict[str, set[str]] = {c: set() for c in sizes}
    for q in cliques:
        for a, b in combinations(q, 2):
            near[a].add(b)
            near[b].add(a)
    left, found = dict(near), []
    while left:

        def cost(c: str) -> tuple:
            missing = sum(b not in left[a] for a, b in combinations(sorted(left[c]), 2))
            return missing, float(np.prod([float(sizes[x]) for x in {c, *left[c]}])), c

        c = min(left, key=cost)
        group = {c, *left[c]}
        found.append(frozenset(group))
        for a, b in combinations(left[c], 2):
            left[a].add(b)
            left[b].add(a)
        for a in left.pop(c):
            left[a].discard(c)
    order = list(sizes)
    largest = [q for q in found if not any(q < other for other in found)]
    return [tuple(sorted(q, key=order.index)) for q in dict.fromkeys(largest)]


def model_megabytes(sizes: Mapping[str, int], cliques: Iterable[Clique]) -> float:
    """Size of the junction tree that the cliques imply, at 8 bytes a cell."""
    return sum(float(np.prod([float(sizes[c]) for c in q])) for q in triangulate(sizes, cliques)) * 8 / 2**20


class Model:
    """A Markov random field: log potentials on junction-tree cliques, normalised to ``total``."""

    def __init__(self, sizes: Mapping[str, int], cliques: Iterable[Clique], total: float = 1.0) -> None:
        self.sizes, self.total = dict(sizes), max(float(total), 1.0)
        self.measured = list(dict.fromkeys(tuple(q) for q in cliques))
        self.cliques = triangulate(sizes, self.measured)
        self.log = {q: np.zeros([sizes[c] for c in q]) for q in self.cliques}
        self.tree = self._spanning_tree()
        self.beliefs = self.log
        self.calibrate()

    def _spanning_tree(self) -> list[tuple[int, int, Clique]]:
        """(child, parent, separator), parents first."""
        joined, edges = [0], []
        while len(joined) < len(self.cliques):
            best = max(((len(set(self.cliques[i]) & set(self.cliques[j])), -j, i, j) for i in joined for j in range(len(self.cliques)) if j not in joined))
            _, _, i, j = best
            edges.append((j, i, tuple(c for c in self.cliques[j] if c in self.cliques[i])))
            joined.append(j)
        return edges

    @staticmethod
    def _spread(x: np.ndarray, own: Clique, to: Clique) -> np.ndarray:
        order = [own.index(c) for c in to if c in own]
        return np.transpose(x, order).reshape([x.shape[own.index(c)] if c in own else 1 for c in to])

    @staticmethod
    def _log_sum(x: np.ndarray, own: Clique, keep: Clique) -> np.ndarray:
        axes = tuple(i for i, c in enumerate(own) if c not in keep)
        if not axes:
            return x
        top = x.max(axis=axes, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return (np.log(np.exp(x - top).sum(axis=axes, keepdims=True)) + top).squeeze(axis=axes)

    def calibrate(self) -> None:
        """Clique marginals (log) by passing messages up and down the tree."""
        b = [self.log[q].copy() for q in self.cliques]
        up = {}
        for child, parent, sep in reversed(self.tree):
            up[child] = self._log_sum(b[child], self.cliques[child], sep)
            b[parent] = b[parent] + self._spread(up[child], sep, self.cliques[parent])
        for child, parent, sep in self.tree:
            down = self._log_sum(b[parent], self.cliques[parent], sep) - up[child]
            b[child] = b[child] + self._spread(down, sep, self.cliques[child])
        scale = np.log(self.total)
        self.beliefs = {q: x - self._log_sum(x, q, ()) + scale for q, x in zip(self.cliques, b)}

    def project(self, clique: Clique) -> np.ndarray:
        """Expected counts of any set of columns, in their order."""
        for q in sorted(self.cliques, key=lambda q: self.beliefs[q].size):
            if set(clique) <= set(q):
                kept = tuple(c for c in q if c in clique)
                x = np.exp(self._log_sum(self.beliefs[q], q, kept))
                return np.transpose(x, [kept.index(c) for c in clique])
        return self._join(clique)

    def _join(self, clique: Clique) -> np.ndarray:
        """Across cliques: product of conditionals over the tree, summed down to the columns."""
        letter = {c: i for i, c in enumerate(self.sizes)}
        args: list = [np.exp(self.beliefs[self.cliques[0]]) / self.total, [letter[c] for c in self.cliques[0]]]
        for child, _, sep in self.tree:
            q = self.cliques[child]
            x = np.exp(self.beliefs[q])
            below = self._spread(np.exp(self._log_sum(self.beliefs[q], q, sep)), sep, q) if sep else self.total
            args += [np.divide(x, below, out=np.zeros_like(x), where=np.broadcast_to(below, x.shape) > 0), [letter[c] for c in q]]
        return self.total * np.einsum(*args, [letter[c] for c in clique], optimize="greedy")

    def loss(self, measurements: Sequence[Measurement]) -> tuple[float, dict[Clique, np.ndarray]]:
        """Half the squared residuals in standard deviations, and their gradient on the tree's cliques."""
        value, grad = 0.0, {q: np.zeros_like(x) for q, x in self.log.items()}
        for m in measurements:
            if not m.clique:
                continue
            mu = self.project(m.clique)
            coef = 1.0 if m.coef is None else m.coef.reshape(mu.shape)
            diff = (mu * coef - m.values.reshape(mu.shape)) / m.stddev
            value += 0.5 * float((diff * diff).sum())
            home = next(q for q in self.cliques if set(m.clique) <= set(q))
            grad[home] += self._spread(diff * coef / m.stddev, m.clique, home)
        return value, grad


def estimate(sizes: Mapping[str, int], measurements: Sequence[Measurement], iterations: int = 1000, start: Model | None = None, total: float | None = None) -> Model:
    """The model closest to the measurements, by entropic mirror descent with a backtracking step."""
    if total is None:
        known = [float(m.values.sum()) for m in measurements if not m.clique]
        sums = [(float(m.values.sum()), m.stddev**2 * m.values.size) for m in measurements if m.clique and m.coef is None]
        total = known[0] if known else sum(t / v for t, v in sums) / sum(1 / v for _, v in sums) if sums else 1.0
    model = Model(sizes, [m.clique for m in measurements if m.clique], total)
    if start is not None:
        for q, x in start.log.items():
            home = next((t for t in model.cliques if set(q) <= set(t)), None)
            if home:
                model.log[home] = model.log[home] + model._spread(x, q, home)
        model.calibrate()
    value, grad = model.loss(measurements)
    step = 1.0 / model.total
    for _ in range(iterations):
        before = {q: x.copy() for q, x in model.log.items()}
        for _ in range(25):
            model.log = {q: before[q] - step * grad[q] for q in before}
            model.calibrate()
            new, new_grad = model.loss(measurements)
            if new <= value:
                break
            step /= 2
        gain, value, grad = value - new, new, new_grad
        step *= 1.5
        if gain <= 1e-9 * max(1.0, value):
            break
    return model


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but row number and salt."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def sample_rows(spark: SparkSession, model: Model, rows: int, seed: int = 0) -> DataFrame:
    """``rows`` coded rows drawn clique by clique down the tree; executors hold the conditionals, of the model's size."""
    order = [(self_q, ()) for self_q in model.cliques[:1]] + [(model.cliques[c], sep) for c, _, sep in model.tree]
    plan = []
    for q, sep in order:
        new = tuple(c for c in q if c not in sep)
        x = np.transpose(np.exp(model.beliefs[q]), [q.index(c) for c in (*sep, *new)])
        table = x.reshape(int(np.prod([model.sizes[c] for c in sep])) if sep else 1, -1)
        sums = table.sum(1, keepdims=True)
        table = np.where(sums > 0, table / np.where(sums > 0, sums, 1), 1 / table.shape[1])
        plan.append((sep, new, np.cumsum(table, 1)))
    shared = spark.sparkContext.broadcast(plan)
    sizes = model.sizes
    schema = ", ".join(["row_id long", *[f"`{c}` int" for c in sizes]])

    def draw(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            out: dict[str, np.ndarray] = {"row_id": ids}
            for k, (sep, new, table) in enumerate(shared.value):
                row = np.ravel_multi_index([out[c] for c in sep], [sizes[c] for c in sep]) if sep else np.zeros(len(ids), int)
                u = _uniform(ids, seed * 1000 + k)
                cell = np.empty(len(ids), int)
                for at in np.unique(row):
                    mine = row == at
                    cell[mine] = np.minimum(np.searchsorted(table[at], u[mine], side="right"), table.shape[1] - 1)
                for c, codes in zip(new, np.unravel_index(cell, [sizes[c] for c in new])):
                    out[c] = codes
            yield pd.DataFrame(out)[["row_id", *sizes]]

    return spark.range(rows).mapInPandas(draw, schema)
