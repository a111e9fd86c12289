"""Attribute domains and their encodings as pairs of Column builders (value to code, and back)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Builder = Callable[[Column], Column]


@dataclass(frozen=True)
class Categorical:
    """A finite ordered list of values; unknown values, typos and nulls take the code ``other``."""

    values: tuple
    other: int = 0

    def __post_init__(self) -> None:
        if not self.values:
            raise ValueError("a categorical domain needs at least one value")
        if not 0 <= self.other < len(self.values):
            raise ValueError(f"code {self.other} lies outside a domain of {len(self.values)} values")

    @property
    def size(self) -> int:
        return len(self.values)


@dataclass(frozen=True)
class Numerical:
    """A closed range; ``clip`` maps what lies outside to its ends, else such values have a code of their own."""

    low: float
    high: float
    clip: bool = True
    kind: str = "float"

    def __post_init__(self) -> None:
        if self.low > self.high:
            raise ValueError(f"range [{self.low}, {self.high}] is empty")
        if self.kind not in ("int", "float"):
            raise ValueError(f"unknown kind {self.kind!r}")

    @property
    def open_low(self) -> float:
        """The largest number of the kind below the range: left end of the first right-closed bin."""
        return self.low - 1 if self.kind == "int" else float(np.nextafter(self.low, -math.inf))


@dataclass(frozen=True)
class Encoding:
    """Column builders to codes and back, and the number of codes."""

    forward: Builder
    inverse: Builder
    size: int
    labels: tuple = field(default=())

    def __matmul__(self, first: Encoding) -> Encoding:
        """``self @ first``: ``first``, then ``self``; the inverse runs the other way round."""
        return Encoding(lambda c: self.forward(first.forward(c)), lambda c: first.inverse(self.inverse(c)), self.size, self.labels)


def _lookup(pairs: Sequence[tuple], key: Column, default: Column) -> Column:
    flat = [F.lit(x) for pair in pairs for x in pair]
    return F.coalesce(F.element_at(F.create_map(*flat), key), default) if flat else default


def categorical(domain: Categorical) -> Encoding:
    """Values to positions in the domain."""
    known = [(v, i) for i, v in enumerate(domain.values) if v is not None]
    missing = domain.values.index(None) if None in domain.values else domain.other
    back = F.array(*[F.lit(v) for v in domain.values])
    return Encoding(
        lambda c: F.when(c.isNull(), F.lit(missing)).otherwise(_lookup(known, c, F.lit(domain.other))),
        lambda c: F.element_at(back, c.cast("int") + 1),
        domain.size,
        domain.values,
    )


def bins(domain: Numerical, edges: Sequence[float]) -> Encoding:
    """Right-closed bins between inner ``edges``.

    Text that is no number, null and NaN count as below the range. Without clipping, code 0 stands for everything
    outside. The inverse gives a bin's middle, rounded up for whole numbers.
    """
    if not edges:
        raise ValueError("no inner edges")
    if edges[0] < domain.low or edges[-1] >= domain.high:
        raise ValueError(f"edges {list(edges)} leave the range [{domain.low}, {domain.high})")
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError(f"edges {list(edges)} do not increase")
    cuts = [float(e) for e in edges]
    shift = 0 if domain.clip else 1
    n = len(cuts) + 1
    ends = [domain.open_low, *cuts, domain.high]

    def forward(c: Column) -> Column:
        x = c.cast("string").try_cast("double")
        # number of inner edges strictly below the value: the position of its right-closed bin
        inside = reduce(lambda acc, e: acc + (x > F.lit(e)).cast("int"), cuts, F.lit(shift))
        low, high = F.lit(0), F.lit(n - 1 if domain.clip else 0)
        return F.when(x.isNull() | F.isnan(x) | (x < domain.low), low).when(x > domain.high, high).otherwise(inside)

    middles = [(a + b) / 2 for a, b in zip(ends, ends[1:])]
    if domain.kind == "int":
        middles = [float(math.ceil(m)) for m in middles]
    back = F.array(*[F.lit(None).cast("double")] * shift, *[F.lit(float(m)) for m in middles])
    labels = (None,) * shift + tuple(zip(ends, ends[1:]))
    return Encoding(forward, lambda c: F.element_at(back, c.cast("int") + 1), n + shift, labels)


def uniform_bins(domain: Numerical, count: int) -> Encoding:
    """Bins of equal width; whole-number domains truncate the edges and drop repeated ones."""
    edges = [domain.open_low + (domain.high - domain.open_low) * i / count for i in range(count + 1)]
    if domain.kind == "int":
        edges = sorted({int(e) for e in edges})
    return bins(domain, edges[1:-1])


def merge_rare(rare: Sequence[bool]) -> Encoding:
    """Codes without the rare ones, which share the last code; back from it, one of the rare codes by chance (seeded, but by the place of a row, not by its key)."""
    mask = np.asarray(rare)
    if mask.ndim != 1 or mask.dtype != bool:
        raise ValueError(f"a mask of truth values is needed, not {mask.dtype} of {mask.ndim} dimensions")
    kept = [i for i, r in enumerate(mask) if not r]
    gone = [i for i, r in enumerate(mask) if r]
    size = len(kept) + bool(gone)
    new = {old: i for i, old in enumerate(kept)} | {old: size - 1 for old in gone}

    def inverse(c: Column) -> Column:
        one = _lookup(list(enumerate(kept)), c.cast("int"), F.lit(None).cast("int"))
        if not gone:
            return one
        pick = F.element_at(F.array(*map(F.lit, gone)), (F.floor(F.rand(17) * len(gone)) + 1).cast("int"))
        return F.coalesce(one, pick)

    return Encoding(lambda c: _lookup(sorted(new.items()), c.cast("int"), F.lit(size - 1)), inverse, size)


def encode(df: DataFrame, encodings: dict[str, Encoding], reverse: bool = False, drop_others: bool = True) -> DataFrame:
    """Apply an encoding to each named column; other columns go or stay as they are."""
    if missing := [c for c in encodings if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    names = list(encodings) if drop_others else df.columns
    return df.select(*[(encodings[c].inverse if reverse else encodings[c].forward)(F.col(c)).alias(c) if c in encodings else F.col(c) for c in names])


def encoder_for(domain: Categorical | Numerical, numeric_bins: int = 32) -> Encoding:
    return categorical(domain) if isinstance(domain, Categorical) else uniform_bins(domain, numeric_bins)


def out_of_domain(df: DataFrame, domains: dict[str, Categorical]) -> DataFrame:
    """(column, rows): values that silently took the default code."""
    counts = [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin([v for v in d.values if v is not None])).alias(c) for c, d in domains.items()]
    return df.agg(*counts).unpivot([], list(domains), "column", "rows")
