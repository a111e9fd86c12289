"""Privacy accounting: zCDP conversions, Renyi accounting, numerical privacy-loss accounting, noise search, scheme grids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# concentrated differential privacy


# rho-zCDP bounds the Renyi divergence of every order a > 1 by a * rho. Solved for one of delta, eps and rho, the
# conversion at one order is closed; each function below takes the best order. Orders are written as 1 + e^u.


def _best_order(of: Callable[[float, float], float]) -> float:
    """Least value of ``of(order, log(1 - 1 / order))``, which falls and then rises with the order, by golden sections of u."""
    ratio = (math.sqrt(5) - 1) / 2

    def at(u: float) -> float:
        return of(1 + math.exp(u), u - math.log1p(math.exp(u)))

    low, high = -25.0, 60.0
    x, y = high - ratio * (high - low), low + ratio * (high - low)
    fx, fy = at(x), at(y)
    while high - low > 1e-9:
        if fx <= fy:
            high, y, fy = y, x, fx
            x = high - ratio * (high - low)
            fx = at(x)
        else:
            low, x, fx = x, y, fy
            y = low + ratio * (high - low)
            fy = at(y)
    return min(fx, fy)


def zcdp_delta(rho: float, eps: float) -> float:
    """Least delta for which rho-zCDP gives (eps, delta)."""
    if rho < 0 or eps < 0:
        raise ValueError("rho and eps must not be negative")
    if rho == 0:
        return 0.0
    return math.exp(min(0.0, _best_order(lambda a, shrink: (a - 1) * (a * rho - eps + shrink) - math.log(a))))


def zcdp_eps(rho: float, delta: float) -> float:
    """Least eps for which rho-zCDP gives (eps, delta)."""
    if delta >= 1 or rho == 0:
        return 0.0
    return max(0.0, _best_order(lambda a, shrink: a * rho + shrink - math.log(a * delta) / (a - 1)))


def zcdp_rho(eps: float, delta: float) -> float:
    """Largest rho for which rho-zCDP gives (eps, delta)."""
    if delta >= 1:
        return 0.0
    return max(0.0, -_best_order(lambda a, shrink: -(eps - shrink + math.log(a * delta) / (a - 1)) / a))


def _root(f: Callable[[float], float], low: float, high: float, upper: bool = False, width: float = 1e-10) -> float:
    """Where an increasing function changes its sign, by bisection; ``upper`` takes the end at which it is positive."""
    while high - low > width:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return high if upper else low


def gaussian_sigma(rho: Column | float) -> Column | float:
    """Noise of the Gaussian mechanism of sensitivity 1 under rho-zCDP; numbers or columns."""
    return F.sqrt(0.5 / rho) if isinstance(rho, Column) else math.sqrt(0.5 / rho)


def exponential_eps(rho: Column | float) -> Column | float:
    """Largest eps of the exponential mechanism under rho-zCDP."""
    return F.sqrt(8 * rho) if isinstance(rho, Column) else math.sqrt(8 * rho)


def gdp_sigma(budget: Column | float) -> Column | float:
    """Noise of the Gaussian mechanism for a Gaussian-DP budget."""
    return F.sqrt(1 / budget) if isinstance(budget, Column) else math.sqrt(1 / budget)


def delta_rule(n: Column | float) -> Column | float:
    """delta = 1 / (n ln n)."""
    return 1 / (n * (F.log(n) if isinstance(n, Column) else math.log(n)))


# Renyi differential privacy

#: Integer orders at which the Renyi bound is evaluated.
ORDERS = (*range(2, 64), 128, 256, 512, 1024)


@dataclass(frozen=True)
class Stage:
    """``steps`` Gaussian mechanisms of noise ``sigma`` on Poisson samples of rate ``rate``."""

    sigma: float
    rate: float = 1.0
    steps: int = 1


def _log_binomials(a: int) -> np.ndarray:
    lg = np.array([math.lgamma(k + 1) for k in range(a + 1)])
    return lg[a] - lg - lg[::-1]


def renyi(stage: Stage, order: int) -> float:
    """Renyi divergence bound of one stage at an integer order."""
    s2 = stage.sigma**2
    if stage.rate >= 1:
        return stage.steps * order / (2 * s2)
    k = np.arange(order + 1)
    with np.errstate(divide="ignore"):
        terms = _log_binomials(order) + (order - k) * math.log1p(-stage.rate) + k * math.log(stage.rate) + (k * k - k) / (2 * s2)
    top = terms.max()
    return stage.steps * (top + math.log(np.exp(terms - top).sum())) / (order - 1)


def renyi_epsilon(stages: Iterable[Stage], delta: float) -> float:
    """eps of the composed stages at ``delta``: the best order under the tight conversion; never below 0."""
    stages = list(stages)
    best = math.inf
    for a in ORDERS:
        try:
            r = sum(renyi(s, a) for s in stages)
        except (OverflowError, ValueError):
            continue
        best = min(best, r + math.log1p(-1 / a) - math.log(delta * a) / (a - 1))
    return max(0.0, best)


def search_sigma(epsilon_of: Callable[[float], float], target: float, low: float = 1e-5, high: float = 1000.0, steps: int = 50) -> float:
    """Least noise that meets ``target``; an accountant that overflows counts as infinite eps."""
    for _ in range(steps):
        mid = (low + high) / 2
        try:
            eps = epsilon_of(mid)
        except (OverflowError, ValueError, FloatingPointError):
            eps = math.inf
        if eps > target:
            low = mid
        else:
            high = mid
    return high


def first_stage_sigma(target: float, delta: float, second: Stage) -> float:
    """Noise of one full Gaussian mechanism that leaves room for ``second``; rho follows as 1 / (2 sigma^2)."""
    return search_sigma(lambda s: renyi_epsilon([Stage(s), second], delta), target)


def training_sigma(target: float, delta: float, rate: float, steps: int) -> float:
    """Noise of subsampled training alone."""
    return search_sigma(lambda s: renyi_epsilon([Stage(s, rate, steps)], delta), target)


# numerical privacy-loss accounting

#: Error of eps that is added to the result, at least, and at most where losses reach far; share of delta that covers
#: rounding and cut tails, each; cells of the noise; points of the loss grid at most.
LOSS_ERROR, LOSS_ERROR_MOST, LOSS_TAIL, LOSS_CELLS, LOSS_POINTS = 2e-4, 0.5, 1e-3, 100_000, 1 << 21


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(v) for v in (x / -math.sqrt(2)).ravel()]).reshape(x.shape)


@lru_cache(8)
def _cells(sigma: float, tail: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, base, shifted): cells of the noise that hold all but ``tail`` of it, and both distribution functions at their edges."""
    reach = math.sqrt(2 * math.log(4 / tail))
    xs = np.linspace(-reach * sigma, 1 + reach * sigma, LOSS_CELLS + 1)
    return xs, _normal_cdf(xs / sigma), _normal_cdf((xs - 1) / sigma)


def _losses(stage: Stage, removal: bool, step: float, points: int, tail: float) -> tuple[np.ndarray, float]:
    """(mass on the grid, mass at infinity) of one step's privacy loss.

    Every cell of the noise counts with its largest loss, split between two grid points so that the mean stays; what lies
    beyond the cells or the grid on the side of large losses is infinite, on the other side it counts as the last cell.
    """
    xs, base, shifted = _cells(stage.sigma, tail)
    below = (1 - stage.rate) * base + stage.rate * shifted if removal else base
    expo = (2 * xs - 1) / (2 * stage.sigma**2)
    loss = np.logaddexp(math.log1p(-stage.rate), math.log(stage.rate) + expo) if stage.rate < 1 else expo
    mass = np.diff(below)
    if removal:
        largest, endless = loss[1:], 1 - below[-1]
        mass[0] += below[0]
    else:
        largest, endless = -loss[:-1], below[0]
        mass[-1] += 1 - below[-1]
    at = largest / step
    low = np.floor(at).astype(np.int64)
    share = at - low
    over = low + 1 >= points // 2
    endless += float(mass[over].sum())
    mass = np.where(over, 0.0, mass)
    out = np.zeros(points)
    for place, weight in ((low, 1 - share), (low + 1, share)):
        np.add.at(out, np.clip(place, -points // 2, points // 2 - 1) % points, mass * weight)
    return out, float(endless)


def _loss_reach(stages: Sequence[Stage], tail: float) -> float:
    """A loss that the composed stages exceed, in size, with at most ``tail``: by Markov's inequality over the Renyi bounds."""
    best = math.inf
    for a in ORDERS:
        try:
            best = min(best, sum(renyi(s, a) for s in stages) - math.log(tail) / (a - 1))
        except (OverflowError, ValueError):
            continue
    return max(best, -math.log(tail))


def loss_epsilon(stages: Sequence[Stage], delta: float) -> float:
    """Upper bound of the eps of the composed stages at ``delta`` from their privacy-loss distributions, by Fourier transforms.

    Rounding keeps the mean of each loss, so by Hoeffding's inequality the rounded sum is within an error of the true one
    but for a share of delta. The grid reaches as far as the Renyi bounds say; its error, ``LOSS_ERROR`` or what so many
    points need to reach that far, is added. Losses that would need more than ``LOSS_ERROR_MOST`` are refused.
    """
    spare = LOSS_TAIL * delta
    steps = sum(s.steps for s in stages)
    reach, spread = _loss_reach(stages, spare), math.sqrt(steps / 2 * math.log(2 / spare))
    error = max(LOSS_ERROR, 2.01 * reach / LOSS_POINTS * spread)
    if not error <= LOSS_ERROR_MOST:
        raise ValueError("the privacy losses of these stages do not fit on the grid")
    step = error / spread
    points = 1 << math.ceil(math.log2(2 * reach / step + 2))
    values = (np.arange(points) + points // 2) % points - points // 2
    worst = 0.0
    for removal in (True, False):
        spectrum, finite = np.ones(points // 2 + 1, complex), 0.0
        for s in stages:
            mass, endless = _losses(s, removal, step, points, spare / steps)
            spectrum *= np.fft.rfft(mass) ** s.steps
            finite += s.steps * math.log1p(-endless)
        mass = np.maximum(np.fft.irfft(spectrum, points), 0)
        loss = values * step
        lost = -math.expm1(finite) + 2 * spare  # infinite losses, and what rounding and the grid's ends may hide

        def spent(eps: float, mass=mass, loss=loss, lost=lost) -> float:
            above = loss > eps
            return float((mass[above] * -np.expm1(eps - loss[above])).sum()) + lost

        if spent(reach) > delta:
            raise ValueError("delta is too small for the grid of privacy losses")
        worst = max(worst, _root(lambda e: delta - spent(e), 0.0, reach, upper=True, width=1e-6))
    return worst + error


def noise_multiplier(target: float, delta: float, rate: float, steps: int, numeric: bool = True) -> float:
    """Noise for training under (target, delta): none from eps 100 on; the Renyi bound narrows the numerical search."""
    if target >= 100:
        return 0.0
    bound = training_sigma(target, delta, rate, steps)
    if not numeric:
        return bound
    return _walked_search(lambda s: loss_epsilon([Stage(s, rate, steps)], delta), target, bound, 9)


def _walked_search(epsilon_of: Callable[[float], float], target: float, high: float, steps: int, least: float = 1e-4) -> float:
    """Least noise that meets ``target``, given one that does; the lower end of the bracket is walked down until it fails."""

    def exceeds(sigma: float) -> bool:
        try:
            return epsilon_of(sigma) > target
        except (OverflowError, ValueError, FloatingPointError):
            return True

    low = high / math.sqrt(2)
    while low > least and not exceeds(low):
        high, low = low, low / math.sqrt(2)
    return search_sigma(epsilon_of, target, low, high, steps)


def stepped_sigma(target: float, delta: float, rate: float, steps: int) -> float:
    """Older search: noise raised by 1, then 0.1, then 0.01 until the budget holds."""
    sigma = 1.0
    for width in (1.0, 0.1, 0.01):
        while renyi_epsilon([Stage(sigma, rate, steps)], delta) > target:
            sigma = round(sigma + width, 2)
        if width > 0.01:
            sigma = max(round(sigma - width, 2), 0.01)
    while renyi_epsilon([Stage(sigma, rate, steps)], delta) > target:
        sigma = round(sigma + 0.01, 2)
    return sigma


def second_stage_sigma(target: float, delta: float, first: Stage, rate: float, steps: int) -> float:
    """Noise of a second stage after ``first``; NaN if ``first`` alone breaks the budget."""
    if renyi_epsilon([first], delta) >= target:
        return math.nan
    high = 1.0
    while renyi_epsilon([first, Stage(high, rate, steps)], delta) > target:
        high *= math.sqrt(2)
        if high > 1e4:
            return math.nan
    return _walked_search(lambda s: renyi_epsilon([first, Stage(s, rate, steps)], delta), target, high, 30)


def training_steps(n: int, batch: int, epochs: float) -> int:
    return int(epochs / (batch / n))


def accumulation(batch: int, device_batch: int, devices: int) -> int:
    return max(1, batch // (device_batch * devices))


SCHEME = "bs1 int, T1 int, nm1 double, eps1_ind double, bs2 int, T2 int, nm2 double, eps2_ind double, total_eps double"


def scheme_grid(spark: SparkSession, n: int, target: float, delta: float, first_eps: Sequence[float], first: Sequence[tuple[int, int]], second: Sequence[tuple[int, int]], tolerance: float = 0.05) -> DataFrame:
    """Two-stage schemes that meet ``target`` within ``tolerance``, sorted; the grid is spread over tasks.

    ``first`` and ``second`` hold (batch, steps); first-stage budgets at or above the target are left out.
    """
    eps = spark.createDataFrame([(float(e),) for e in first_eps], "eps1 double").filter(F.col("eps1") < target)
    one = spark.createDataFrame(list(first), "bs1 int, T1 int")
    two = spark.createDataFrame(list(second), "bs2 int, T2 int")
    grid = eps.crossJoin(one).crossJoin(two).repartition("eps1", "bs1", "T1")  # a parameter grid, not data

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                s1 = training_sigma(r.eps1, delta, r.bs1 / n, r.T1)
                stage1 = Stage(s1, r.bs1 / n, r.T1)
                s2 = second_stage_sigma(target, delta, stage1, r.bs2 / n, r.T2)
                if math.isnan(s2):
                    continue
                stage2 = Stage(s2, r.bs2 / n, r.T2)
                out.append((r.bs1, r.T1, round(s1, 2), round(renyi_epsilon([stage1], delta), 2), r.bs2, r.T2, round(s2, 2), round(renyi_epsilon([stage2], delta), 2), round(renyi_epsilon([stage1, stage2], delta), 2)))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEME.split(", ")])

    found = grid.mapInPandas(solve, SCHEME)
    return found.filter(F.abs(F.col("total_eps") - target) < tolerance).orderBy("eps1_ind", "T1", "T2")
