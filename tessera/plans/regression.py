"""Panel regression with interactive effects and no treatment, and trend columns for multi-level models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, stats
from ..operators import panel
from . import inference, jobs
from .spec import FitOptions, PanelSpec


def _coefficients(p: jobs.Dense, kind: str, params: dict):
    if kind == "bootstrap":
        p = p.take(np.random.default_rng(params["seed"]).integers(0, len(p.units), len(p.units)))
    got = kernels.interactive(p.y, p.obs, p.x, params["r"], params["force"], params["tol"], params["max_iter"], p.w if params["weighted"] else None)
    return [("beta", float(k), float(b), int(p.obs.sum())) for k, b in enumerate(got.beta)] + [("sigma2", 0.0, float(got.sigma2), int(p.obs.sum()))]


def interactive_regression(df: DataFrame, y: str, x: tuple[str, ...], unit: str, time: str, r: int = 0, force: str = "two-way", weight: str | None = None, nboots: int = 0, tol: float = 1e-6, max_iter: int = 2000, seed: int = 1) -> DataFrame:
    """(term, estimate, se, ci_low, ci_high, p_value): covariates' coefficients and sigma2; uncertainty from units drawn
    with replacement if ``nboots`` is set."""
    rows = df.withColumn("__none", F.lit(0))
    cells = panel.densify(rows, PanelSpec(y=y, d="__none", unit=unit, time=time, x=x, weight=weight))
    cells = panel.with_usable(panel.with_carry(cells, 0), FitOptions()).withColumn("t_on", F.lit(None).cast("int")).withColumn("t_off", F.lit(None).cast("int"))
    p = jobs.dense(cells, tuple(f"x{i + 1}" for i in range(len(x))))
    spark = df.sparkSession
    base = {"r": r, "force": force, "tol": tol, "max_iter": max_iter, "weighted": weight is not None}
    point = jobs.run(p, jobs.table(spark, [(0, "point", base)]), _coefficients, spark).where("error is null").select("kind", "at", "value", "n_cells")
    names = F.array(*(F.lit(c) for c in [*x, "sigma2"]))
    term = F.element_at(names, F.when(F.col("kind") == "beta", F.col("at").cast("int") + 1).otherwise(len(x) + 1)).alias("term")
    if not nboots:
        return point.select(term, F.col("value").alias("estimate"))
    reps = jobs.run(p, jobs.table(spark, [(i, "bootstrap", base | {"seed": seed * 31337 + i}) for i in range(nboots)]), _coefficients, spark)
    out = inference.intervals(point, reps, "bootstrap")
    return out.select(term, F.col("value").alias("estimate"), "se", "ci_low", "ci_high", "p_value")


def with_trend(df: DataFrame, time: str, kind: str = "linear", prefix: str = "trend_") -> tuple[DataFrame, tuple[str, ...]]:
    """Add trend columns of the periods (linear, quadratic, cubic or bspline), one basis row a period joined back; the names
    go into PanelSpec.q."""
    periods = panel.periods(df.select(F.col(time).alias("time")))
    basis = stats.spline_basis(np.arange(len(periods), dtype=float), kind)
    names = tuple(f"{prefix}{k + 1}" for k in range(basis.shape[1]))
    schema = f"{time} {df.schema[time].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    table = df.sparkSession.createDataFrame([(t, *map(float, row)) for t, row in zip(periods, basis, strict=True)], schema)
    return df.join(F.broadcast(table), time), names


def implied_weights(fit) -> DataFrame:
    """(unit, control, weight): how much each control's outcome counts in a unit's counterfactual, from the loadings of a
    factor model on never-treated units (least-squares weights)."""
    ever = {r["unit"]: r["ever"] for r in fit.cells.groupBy("unit").agg(F.max("ever").alias("ever")).collect()}
    rows = fit.units.collect()  # a dense panel's units: bounded by its checked size
    control = [r for r in rows if not ever[r["unit"]]]
    load = np.array([r["loadings"] for r in control], float)
    project = np.linalg.pinv(load.T)
    kind = fit.cells.schema["unit"].dataType.simpleString()
    out = [(r["unit"], c["unit"], float(w)) for r in rows if ever[r["unit"]] for c, w in zip(control, project @ np.array(r["loadings"], float), strict=True)]
    return fit.cells.sparkSession.createDataFrame(out, f"unit {kind}, control {kind}, weight double")
