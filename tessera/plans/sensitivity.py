"""Intervals of post-treatment effects that stay valid when parallel trends fail by a bounded amount.

Estimates at event times before treatment show the bias path delta directly, without a reference period, and delta goes on after treatment:

* ``relative``: |delta(t+1) - delta(t)| for t >= 0 is at most ``bound`` times the largest such change before treatment. The set
  is a union of polyhedra, one for each earlier change and sign that may be the largest; the interval is the hull of theirs.
* ``smooth``: second differences of delta are at most ``bound`` in size, everywhere.

Two methods invert tests or optimise an estimator over these sets:

* ``conditional`` (both sets): the moment inequalities A delta <= b are tested at every value of a grid with the hybrid of the
  conditional and the least favourable test. The statistic is a linear programme over the effects that the target leaves free; its dual
  solution gives the truncated normal that the statistic follows.
* ``fixed`` (smooth only): the shortest fixed-length interval around an affine estimator, whose weights on earlier estimates cancel
  every linear trend and trade worst-case bias for variance.

The effects and their covariance are a few numbers an event time, as replicates gave them. Each interval is a job of its own, so bounds,
targets and polyhedra run side by side."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linear_programs, stats
from . import inference
from .fit import FitResult

RESULT = "restriction string, method string, bound double, target string, ci_low double, ci_high double"
#: Draws behind the least favourable critical value, points of the grid, and the share of the level that goes to the first stage.
DRAWS, POINTS, FIRST_STAGE = 1000, 101, 0.1


@dataclass
class Path:
    """Effects by event time, earlier ones first: ``at`` ascends without gaps from ``n_pre`` periods up to event time 0."""

    at: list[int]
    value: np.ndarray
    cov: np.ndarray
    n_cells: np.ndarray

    @property
    def n_pre(self) -> int:
        return sum(a <= 0 for a in self.at)

    def weights(self, target: str) -> np.ndarray:
        """Weights of the target over later event times: all of them by their cells, or one."""
        post = np.array([a for a in self.at if a > 0])
        n = self.n_cells[self.n_pre :].astype(float)
        return n / n.sum() if target == "overall" else (post == int(target)).astype(float)


def path(fit: FitResult, pre: tuple[int, int] | None = None, post: tuple[int, int] | None = None) -> Path:
    """The fit's event-time effects with their covariance over replicates. ``pre`` and ``post`` limit event times; without ``pre`` a placebo
    fit uses its own window. A gap ends the path: the sets need consecutive periods."""
    pre = pre or fit.options.placebo or (-(10**6), 0)
    post = post or (1, 10**6)
    rows = {int(r["at"]): r for r in fit.intervals().where("kind = 'event'").collect() if r["se"] and (pre[0] <= r["at"] <= pre[1] or post[0] <= r["at"] <= post[1])}
    low, high = 0, 0
    while low - 1 in rows:
        low -= 1
    while high + 1 in rows:
        high += 1
    at = list(range(low, high + 1))
    if 0 not in rows or len([a for a in at if a <= 0]) < 2 or high < 1:
        raise ValueError("sensitivity needs effects at two consecutive event times up to 0 and at one after it")
    pairs = {(r["at_a"], r["at_b"]): r["cov"] or 0.0 for r in inference.covariance(fit.replicates.where(F.col("at").between(low, high))).collect()}
    cov = np.array([[pairs.get((float(a), float(b)), 0.0) for b in at] for a in at])
    if fit.vartype == "jackknife":
        n = fit.replicates.select("job_id").distinct().count()
        cov = cov * (n - 1) ** 2 / n
    return Path(at, np.array([rows[a]["value"] for a in at]), cov, np.array([rows[a]["n_cells"] for a in at]))


def folded_quantile(bias: float, level: float) -> float:
    """The ``level`` quantile of |N(bias, 1)|."""
    low, high = 0.0, abs(bias) + 10.0
    for _ in range(100):
        mid = (low + high) / 2
        if stats.norm_cdf(mid - bias) - stats.norm_cdf(-mid - bias) < level:
            low = mid
        else:
            high = mid
    return high


def _second_differences(n: int) -> np.ndarray:
    out = np.zeros((max(n - 2, 0), n))
    for i in range(n - 2):
        out[i, i : i + 3] = 1, -2, 1
    return out


def knots(n: int) -> np.ndarray:
    """K with K c the bias of the estimator c' beta for a unit of each second difference, if c cancels linear trends."""
    return np.maximum(np.arange(n)[None, :] - np.arange(1, n - 1)[:, None], 0.0)


def fixed_length(p: Path, target: np.ndarray, bound: float, level: float = 0.95) -> tuple[float, float]:
    """The fixed-length interval over the smooth set.

    For each price of bias the weights minimise variance + price * bias, by reweighted least squares under the two equations that cancel
    a level and a slope; the price is then searched for the shortest interval. Any such weights give a valid interval."""
    n, k = len(p.at), p.n_pre
    bends, times = knots(n), np.arange(n)
    equations = np.stack([np.ones(k), times[:k].astype(float)])
    fixed = np.concatenate([np.zeros(k), target])
    right = -np.array([target.sum(), target @ times[k:]])

    def solved(price: float) -> np.ndarray:
        v = np.linalg.lstsq(equations, right, rcond=None)[0]
        size = np.ones(len(bends))
        for _ in range(300 if price else 1):
            # |x| <= x^2 / (2 s) + s / 2, with equality at s = |x|
            h = 2 * p.cov[:k, :k] + price * (bends[:, :k].T / size) @ bends[:, :k]
            g = 2 * p.cov[:k, k:] @ target + price * (bends[:, :k].T / size) @ (bends[:, k:] @ target)
            kkt = np.block([[h, equations.T], [equations, np.zeros((2, 2))]])
            new = np.linalg.lstsq(kkt, np.concatenate([-g, right]), rcond=None)[0][:k]
            done = np.abs(new - v).max() < 1e-10 * max(1.0, np.abs(v).max())
            v, size = new, np.maximum(np.abs(bends @ np.concatenate([new, target])), 1e-9)
            if done:
                break
        return np.concatenate([v, target])

    def length(price: float) -> tuple[float, np.ndarray]:
        c = solved(price)
        se = float(np.sqrt(max(c @ p.cov @ c, 1e-300)))
        bias = bound * float(np.abs(bends @ c).sum())
        return folded_quantile(bias / se, level) * se, c

    scale = float(np.trace(p.cov)) / n
    prices = [0.0, *(scale * 10.0**e for e in np.linspace(-4, 6, 41))] if bound > 0 and k > 2 else [0.0]
    half, c = min((length(x) for x in prices), key=lambda r: r[0])
    centre = float(c @ p.value)
    return centre - half, centre + half


def polyhedra(p: Path, kind: str, bound: float) -> list[np.ndarray | tuple[np.ndarray, np.ndarray]]:
    """(A, b) with the set as the union of {delta: A delta <= b}."""
    n, k = len(p.at), p.n_pre
    if kind == "smooth":
        d = _second_differences(n)
        return [(np.concatenate([d, -d]), np.full(2 * len(d), float(bound)))]
    steps = np.diff(np.eye(n), axis=0)
    out = []
    for s in range(k - 1):
        for sign in (1.0, -1.0):
            limit = bound * sign * steps[s]
            out.append((np.concatenate([steps[k - 1 :] - limit, -steps[k - 1 :] - limit]), np.zeros(2 * (n - k))))
        if bound == 0:
            break  # the same set whichever change is the largest
    return out[:1] if bound == 0 else out


def truncated_quantile(level: float, low: float, high: float, sd: float) -> float:
    """A quantile of N(0, sd^2) within [low, high], from whichever tail is exact there."""
    below = lambda x: 0.5 * math.erfc(-x / (sd * math.sqrt(2)))
    if low > 0:
        share = below(-low) - level * (below(-low) - below(-high))
        return -sd * stats.norm_ppf(share) if share > 0 else low
    share = below(low) + level * (below(high) - below(low))
    return sd * stats.norm_ppf(share) if 0 < share < 1 else high


class Inequalities:
    """Tests of the target's value from moment inequalities E[A beta - b] - (effects' part) <= 0."""

    def __init__(self, p: Path, a: np.ndarray, b: np.ndarray, target: np.ndarray, level: float, seed: int = 1):
        k, m = p.n_pre, len(p.at) - p.n_pre
        # effects = base * target value + rest @ free, with target' base = 1 and target' rest = 0
        self.base = target / (target @ target)
        self.rest = np.linalg.svd(target[None, :])[2][1:].T
        later = np.abs(a[:, k:]).sum(axis=1) > 0  # inequalities among earlier periods alone say nothing about the target and cost power
        a, b = a[later], b[later]
        self.y, self.cov = a @ p.value - b, a @ p.cov @ a.T
        self.slope, self.free = a[:, k:] @ self.base, a[:, k:] @ self.rest
        self.scale = np.sqrt(np.maximum(np.diag(self.cov), 1e-12 * max(float(np.diag(self.cov).max()), 1e-300)))
        self.alpha = 1 - level
        self.first = FIRST_STAGE * self.alpha
        rng = np.random.default_rng(seed)
        values, vectors = np.linalg.eigh((self.cov + self.cov.T) / 2)
        draws = rng.standard_normal((DRAWS, len(values))) @ (vectors * np.sqrt(np.maximum(values, 0))).T
        self.least_favourable = float(np.quantile([self.statistic(x)[0] for x in draws], 1 - self.first))
        assert self.rest.shape == (m, m - 1)

    def statistic(self, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """min eta with y - free @ x <= eta * scale: its value, the dual weights and their support."""
        equations = np.concatenate([self.free.T, self.scale[None, :]])
        right = np.append(np.zeros(self.free.shape[1]), 1.0)
        got = linear_programs.minimise(-y, equations, right)
        return -got.value, got.x, got.basis

    def rejects(self, value: float) -> bool:
        y = self.y - self.slope * value
        eta, weights, basis = self.statistic(y)
        if eta > self.least_favourable:
            return True
        sd2 = float(weights @ self.cov @ weights)
        if sd2 <= 1e-300 or eta <= 0:
            return False
        low, high = self.interval(y, weights, basis, eta, sd2)
        level = 1 - (self.alpha - self.first) / (1 - self.first)
        return eta > max(0.0, truncated_quantile(level, low, min(high, self.least_favourable), float(np.sqrt(sd2))))

    def interval(self, y: np.ndarray, weights: np.ndarray, basis: np.ndarray, eta: float, sd2: float) -> tuple[float, float]:
        """Values of the statistic at which the same dual weights stay optimal, the rest of y being what it is."""
        move = self.cov @ weights / sd2
        still = y - move * eta
        design = np.concatenate([self.scale[:, None], self.free], axis=1)
        rows = basis[basis < len(y)]
        inverse = np.linalg.pinv(design[rows])
        # slack = design @ solution - y is linear in the statistic and must not be negative
        at_zero = design @ (inverse @ still[rows]) - still
        per_unit = design @ (inverse @ move[rows]) - move
        other = np.ones(len(y), bool)
        other[rows] = False
        rise, fall = other & (per_unit > 1e-10), other & (per_unit < -1e-10)
        low = float((-at_zero[rise] / per_unit[rise]).max(initial=-np.inf))
        high = float((-at_zero[fall] / per_unit[fall]).min(initial=np.inf))
        return min(low, eta), max(high, eta)


def conditional(p: Path, a: np.ndarray, b: np.ndarray, target: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """The values that the test doesn't reject: a coarse grid that widens until both ends are rejected, then bisection at the ends."""
    test = Inequalities(p, a, b, target, level)
    k = p.n_pre
    centre = float(target @ p.value[k:])
    se = float(np.sqrt(target @ p.cov[k:, k:] @ target)) + float(np.sqrt(np.trace(p.cov[:k, :k])))
    reach = 10 * se + float(np.abs(p.value).max())
    for _ in range(12):
        grid = np.linspace(centre - reach, centre + reach, POINTS)
        kept = [not test.rejects(x) for x in grid]
        if any(kept) and not kept[0] and not kept[-1]:
            break
        if any(kept):
            reach *= 2  # the set reaches beyond the grid
        else:
            reach /= 2  # the grid is too coarse for the set
    else:
        return (-np.inf, np.inf) if any(kept) else (np.nan, np.nan)
    inside = np.flatnonzero(kept)
    ends = []
    for good, bad in ((grid[inside[0]], grid[inside[0] - 1]), (grid[inside[-1]], grid[inside[-1] + 1])):
        for _ in range(25):
            mid = (good + bad) / 2
            good, bad = (good, mid) if test.rejects(mid) else (mid, bad)
        ends.append(float(good))
    return ends[0], ends[1]


def intervals(p: Path, spark, kind: str = "relative", bounds: tuple[float, ...] = (0.0, 0.5, 1.0), targets: tuple[str, ...] = ("overall",), method: str | None = None, level: float = 0.95) -> DataFrame:
    """restriction, method, bound, target, ci_low and ci_high, one row for each bound and target, from a job for each polyhedron."""
    method = method or ("fixed" if kind == "smooth" else "conditional")
    if kind not in ("relative", "smooth") or method not in ("conditional", "fixed") or (kind, method) == ("relative", "fixed"):
        raise ValueError("kind is relative (conditional) or smooth (fixed or conditional)")
    jobs = []
    for bound in bounds:
        for target in targets:
            if method == "fixed":
                jobs.append((float(bound), target, "null"))
            else:
                jobs += [(float(bound), target, json.dumps([a.tolist(), b.tolist()])) for a, b in polyhedra(p, kind, bound)]
    made = spark.createDataFrame([(i, *job) for i, job in enumerate(jobs)], "job long, bound double, target string, body string").repartition(max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)), "job")

    def run(batches):
        for rows in batches:
            out = []
            for job in rows.itertuples():
                l_vec = p.weights(job.target)
                low, high = fixed_length(p, l_vec, job.bound, level) if method == "fixed" else conditional(p, *(np.array(x) for x in json.loads(job.body)), l_vec, level)
                out.append((kind, method, job.bound, job.target, low, high))
            yield pd.DataFrame(out, columns=["restriction", "method", "bound", "target", "ci_low", "ci_high"])

    # a polyhedron that is rejected everywhere adds nothing to the union
    found = made.mapInPandas(run, RESULT)
    return found.groupBy("restriction", "method", "bound", "target").agg(F.min(F.nanvl("ci_low", F.lit(None).cast("double"))).alias("ci_low"), F.max(F.nanvl("ci_high", F.lit(None).cast("double"))).alias("ci_high"))


def original(p: Path, spark, targets: tuple[str, ...] = ("overall",), level: float = 0.95) -> DataFrame:
    """The intervals without any allowance for bias; they have no bound."""
    z, k, out = stats.norm_ppf(0.5 + level / 2), p.n_pre, []
    for target in targets:
        w = p.weights(target)
        centre, se = float(w @ p.value[k:]), float(np.sqrt(w @ p.cov[k:, k:] @ w))
        out.append(("none", "normal", None, target, centre - z * se, centre + z * se))
    return spark.createDataFrame(out, RESULT)


def sensitivity(fit: FitResult, restriction: str = "relative", bounds: tuple[float, ...] | None = None, by_period: bool = False, pre: tuple[int, int] | None = None, post: tuple[int, int] | None = None, method: str | None = None, level: float = 0.95) -> DataFrame:
    """The original interval and those under the bounds, for the count-weighted mean effect or, ``by_period``, for each later event time."""
    p, spark = path(fit, pre, post), fit.cells.sparkSession
    if bounds is None:
        bounds = (0.0, 0.5, 1.0) if restriction == "relative" else (0.0, 0.05, 0.1)
    targets = tuple(str(a) for a in p.at if a > 0) if by_period else ("overall",)
    return original(p, spark, targets, level).unionByName(intervals(p, spark, restriction, bounds, targets, method, level))
