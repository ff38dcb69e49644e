"""Resampled uncertainty of the difference-in-differences comparators: one job a replicate, units drawn with their
multiplicity (a unit drawn twice counts as two)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import kernels
from . import inference, jobs

METHODS = ("twfe", "st", "iw", "cs_never", "cs_notyet")


def estimate(p: jobs.Dense, method: str) -> list[tuple[str, float, float, int]]:
    """(kind, at, value, n_cells): overall effect, and effects by event time where the method has them."""
    first = np.where(p.ever, np.argmax(np.nan_to_num(p.d) == 1, axis=0), -1)
    keep = first != 0  # always-treated units don't enter
    y, obs, first = p.y[:, keep], p.obs[:, keep], first[keep]
    t = np.arange(len(y))[:, None]
    d = ((first[None, :] > 0) & (t >= first[None, :])).astype(float)
    n = int((d * obs).sum())
    if method == "twfe":
        _, beta = kernels.least_squares_start(y, obs, d[:, :, None], "two-way")
        return [("overall", 0.0, float(beta[0]), n)]
    cohorts = [int(c) for c in np.unique(first[first > 0])]
    if method == "st":
        stacks = [np.flatnonzero((first == c) | (first < 0)) for c in cohorts]
        num = den = 0.0
        for s in stacks:
            dd = d[:, s] - kernels.least_squares_start(d[:, s], obs[:, s], np.zeros((*d[:, s].shape, 0)), "two-way")[0]
            yd = y[:, s] - kernels.least_squares_start(y[:, s], obs[:, s], np.zeros((*d[:, s].shape, 0)), "two-way")[0]
            num += float((dd * yd)[obs[:, s]].sum())
            den += float((dd * dd)[obs[:, s]].sum())
        return [("overall", 0.0, num / den, n)]
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    sums: dict[int, list[float]] = {}
    for c in cohorts:
        own = first == c
        for k in range(len(y)):
            ref = c - 1 if k >= c or method == "iw" else k - 1
            if ref < 0:
                continue
            control = (first < 0) if method != "cs_notyet" else ((first < 0) | (first > max(k, ref))) & ~own
            both = obs[k] & obs[ref]
            if not (both & own).any() or not (both & control).any():
                continue
            att = (y[k] - y[ref])[both & own].mean() - (y[k] - y[ref])[both & control].mean()
            sums.setdefault(k - c + 1, []).append((att, int((both & own).sum())))
    out = [("event", float(e), float(np.average([a for a, _ in v], weights=[m for _, m in v])), sum(m for _, m in v)) for e, v in sorted(sums.items())]
    post = [x for e, v in sums.items() if e >= 1 for x in v]
    return [("overall", 0.0, float(np.average([a for a, _ in post], weights=[m for _, m in post])), n), *out]


def _job(p: jobs.Dense, kind: str, params: dict):
    if kind == "bootstrap":
        p = p.take(inference.draw(p, params["seed"]))
    elif kind == "jackknife":
        p = p.take(np.delete(np.arange(len(p.units)), params["leave"]))
    return estimate(p, params["method"])


def intervals(cells: DataFrame, method: str, vartype: str = "bootstrap", nboots: int = 200, level: float = 0.95, ci: str = "basic", seed: int = 1) -> DataFrame:
    """(kind, at, value, se, interval, p) of a comparator; jackknife errors from pseudo-values."""
    p, spark = jobs.dense(cells), cells.sparkSession
    rows = [(i, "jackknife", {"leave": i, "method": method}) for i in range(len(p.units))] if vartype == "jackknife" else [(i, "bootstrap", {"seed": seed * 65537 + i, "method": method}) for i in range(nboots)]
    point = jobs.run(p, jobs.table(spark, [(0, "point", {"method": method})]), _job, spark).where("error is null").select("kind", "at", "value", "n_cells")
    return inference.intervals(point, jobs.run(p, jobs.table(spark, rows), _job, spark), vartype, level, ci)
