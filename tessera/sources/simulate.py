"""Synthetic panels of known effect, for recovery tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def frame(n: int = 40, t: int = 20, n_treated: int = 12, onset: int = 12, tau: float = 2.0, factors: int = 0, beta: float = 0.0, staggered: bool = False, reversals: bool = False, missing: float = 0.0, noise: float = 1.0, positive: bool = False, seed: int = 0) -> pd.DataFrame:
    """id, time, y, d, x1, grp, eff: additive effects, optional factors, covariate, staggered onset, reversals, gaps."""
    rng = np.random.default_rng(seed)
    alpha, xi = rng.normal(0, 1, n), rng.normal(0, 0.5, t)
    x = rng.normal(0, 1, (n, t))
    y = alpha[:, None] + xi[None, :] + beta * x + rng.normal(0, noise, (n, t))
    if factors:
        y += rng.normal(0, 1, (n, factors)) @ rng.normal(0, 1, (factors, t))
    d = np.zeros((n, t), int)
    for i in range(n_treated):
        start = onset if not staggered else int(rng.integers(int(0.4 * t), int(0.8 * t)))
        d[i, start:] = 1
        if reversals and i % 2 == 0:
            d[i, min(t - 1, start + 4) :] = 0
    eff = tau * d
    y = y + eff
    if positive:
        y = np.exp(0.5 + 0.05 * np.arange(t)[None, :] + 0.3 * d + rng.normal(0, 0.2, (n, t)))
    if missing:
        gone = (rng.random((n, t)) < missing) & (d == 0)
        y = np.where(gone, np.nan, y)
    unit, time = np.meshgrid(np.arange(1, n + 1), np.arange(1, t + 1), indexing="ij")
    return pd.DataFrame({"id": unit.ravel(), "time": time.ravel(), "y": y.ravel(), "d": d.ravel(), "x1": x.ravel(), "grp": (unit % 3).ravel(), "eff": eff.ravel()})


def simulated(spark: SparkSession, **options) -> DataFrame:
    data = frame(**options)
    rows = [(int(r.id), int(r.time), None if np.isnan(r.y) else float(r.y), int(r.d), float(r.x1), str(r.grp)) for r in data.itertuples()]
    return spark.createDataFrame(rows, "id int, time int, y double, d int, x1 double, grp string")
