"""Causal moderation: a second model on treated cells, and the difference of both models' surfaces at plugged-in moderator values.

The model of untreated outcomes has coefficients beta0 and additive effects g0; the same model fitted on treated cells has beta1 and g1. The
effect at moderator value m is the mean over treated cells of the second surface less the first, with m in place of the cell's own
value and all else as it is. Factors belong to neither surface. So theta(m) is a line in m: its slope is the moderator's beta1 - beta0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import additive
from . import inference, jobs
from .fit import FitResult

TREATED = "d = 1 and i_obs = 1"


def _column(fit: FitResult, moderator: str) -> tuple[int, str]:
    if moderator not in fit.spec.x:
        raise ValueError(f"the moderator must be a covariate of the fit, one of {fit.spec.x}")
    if fit.options.sample != "notyettreated" or fit.options.method not in ("fe", "ife"):
        raise ValueError("moderation needs an additive or interactive model of not-yet-treated cells")
    k = fit.spec.x.index(moderator)
    return k, f"x{k + 1}"


def treated_surface(fit: FitResult) -> tuple[DataFrame, np.ndarray]:
    """Treated cells with ``y1``, what the exact two-way model of treated cells predicts for them, and that model's coefficients."""
    x = tuple(f"x{i + 1}" for i in range(len(fit.spec.x)))
    cells = fit.cells.drop("xi", "alpha").withColumn("ii", F.when(F.expr(TREATED), 1).otherwise(0))
    out, info = additive.exact_fit(cells.drop("y0"), x, fit.options.weight_fit and fit.spec.weight is not None)
    keys = ["unit", "time_ix"]
    rows = out.where("ii = 1").select(*keys, F.col("y0").alias("y1")).join(fit.cells.where(TREATED), keys)
    return rows, info["beta"]


def _line(fit: FitResult, k: int, column: str) -> tuple[float, float, int]:
    """theta's value at 0 and slope, and how many treated cells it averages."""
    if fit.options.method == "fe" and fit.options.force == "two-way":
        rows, beta1 = treated_surface(fit)
        slope = float(beta1[k]) - fit.scalars[f"beta_{fit.spec.x[k]}"]
        start, n = rows.agg(F.avg(F.col("y1") - F.col("y0") - F.lit(slope) * F.col(column)), F.count(F.col("y1") - F.col("y0"))).first()
        return start, slope, n
    p = fit.panel or jobs.dense(fit.cells, tuple(f"x{i + 1}" for i in range(len(fit.spec.x))))
    made = jobs.table(fit.cells.sparkSession, [(0, "point", {"fit": inference._fit_arguments(fit.options, False), "k": k, "levels": [0.0, 1.0]})])
    at = {r["at"]: r for r in jobs.run(p, made, _theta, fit.cells.sparkSession).collect()}  # two rows
    if None in (at.get(0.0), at.get(1.0)):
        raise ValueError("the model of treated cells can't be fitted")
    return at[0.0]["value"], at[1.0]["value"] - at[0.0]["value"], at[0.0]["n_cells"]


def theta(fit: FitResult, moderator: str, at: tuple[float, ...] | None = None) -> DataFrame:
    """level, theta and n_cells at the values ``at``, or at every value that a treated cell has."""
    k, column = _column(fit, moderator)
    start, slope, n = _line(fit, k, column)
    if at is None:
        levels = fit.cells.where(TREATED).where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("level")).distinct()
    else:
        levels = fit.cells.sparkSession.createDataFrame([(float(a),) for a in at], "level double")
    return levels.select("level", (F.lit(start) + F.lit(slope) * F.col("level")).alias("theta"), F.lit(n).cast("long").alias("n_cells"))


def _theta(p: jobs.Dense, kind: str, params: dict):
    p = inference._resampled(p, kind, params) if kind != "point" else p
    treated = p.obs & (p.d == 1)
    surface, beta = [], []
    for use in (p.use, treated):
        got = jobs.fit_dense(p, use=use, **params["fit"])
        factors = got.factors @ got.loadings.T if got.factors is not None and got.loadings is not None and got.factors.size else 0.0
        surface.append(got.y0 - factors)
        beta.append(float(got.beta[params["k"]]))
    slope = beta[1] - beta[0]
    cells = (surface[1] - surface[0] - slope * p.x[:, :, params["k"]])[treated]
    cells = cells[np.isfinite(cells)]
    if not len(cells):
        raise ValueError("no treated cell has both surfaces")
    for level in params["levels"]:
        yield "theta", float(level), float(cells.mean() + slope * level), len(cells)


def theta_intervals(fit: FitResult, moderator: str, at: tuple[float, ...], nboots: int = 200, seed: int = 1, level: float = 0.95, method: str = "normal") -> DataFrame:
    """at, value, n_cells, se, ci_low, ci_high, p_value and n_reps: both models are refitted in every replicate, a job each."""
    k, _ = _column(fit, moderator)
    if fit.vartype not in (None, "bootstrap", "jackknife"):
        raise ValueError("moderation is resampled by bootstrap or jackknife")
    spark = fit.cells.sparkSession
    p = fit.panel or jobs.dense(fit.cells, tuple(f"x{i + 1}" for i in range(len(fit.spec.x))))
    vartype = fit.vartype or "bootstrap"
    asked = {"k": k, "levels": [float(a) for a in at]}
    made = [(i, kind, params | asked) for i, kind, params in inference._jobs(p, fit.options, vartype, nboots, seed, False)]
    reps = jobs.run(p, jobs.table(spark, made), _theta, spark)
    point = theta(fit, moderator, at).select(F.lit("theta").alias("kind"), F.col("level").alias("at"), F.col("theta").alias("value"), "n_cells")
    return inference.intervals(point, reps, vartype, level, method).drop("kind")
