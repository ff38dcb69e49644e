"""Tests of the identifying assumptions: pre-trends, placebo, carryover, equivalence, moderation, sensitivity."""

from __future__ import annotations

import itertools
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import inference, jobs
from .fit import FitResult
from .sensitivity import sensitivity  # noqa: F401


def pre_periods(fit: FitResult, proportion: float | None = None) -> list[int]:
    """Event times up to 0 with enough cells; where all there are qualify, the first is left out."""
    rows = fit.event().where("event_time <= 0").collect()  # one row an event time
    if not rows:
        return []
    share = fit.options.proportion if proportion is None else proportion
    top = max(r["n_cells"] for r in rows)
    kept = sorted(r["event_time"] for r in rows if r["n_cells"] >= share * top)
    return kept[1:] if len(kept) == len(rows) and len(kept) > 1 else kept


def pretrend(fit: FitResult, f_threshold: float = 0.5, tost_threshold: float | None = None) -> dict:
    """F test that all pre-period effects are zero, its equivalence version, and the largest TOST p over periods."""
    at = pre_periods(fit)
    est = {r["at"]: r for r in fit.intervals().where("kind = 'event'").collect()}
    cov = {(r["at_a"], r["at_b"]): r["cov"] for r in inference.covariance(fit.replicates).collect()}
    at = [float(a) for a in at if float(a) in est and est[float(a)]["se"]]
    if not at:
        raise ValueError("no pre-period can be tested")
    d = np.array([est[a]["value"] for a in at])
    s = np.array([[cov.get((a, b), 0.0) or 0.0 for b in at] for a in at])
    if fit.vartype == "jackknife":
        n = fit.replicates.select("job_id").distinct().count()
        s = s * (n - 1) ** 2 / n
    n, q = max(2, int(np.mean([est[a]["n_cells"] for a in at]))), len(at)
    n = max(n, q + 2)
    f = float(d @ np.linalg.pinv(s) @ d) * (n - q) / ((n - 1) * q)
    if tost_threshold is None:
        tost_threshold = 0.36 * float(np.sqrt(fit.cells.where("ii = 1").agg(F.var_samp("eff")).first()[0]))
    return {
        "f_stat": f, "df1": q, "df2": n - q, "f_p": 1 - stats.f_cdf(f, q, n - q), "f_equivalence_p": stats.noncentral_f_cdf(f, q, n - q, n * f_threshold),
        "tost_p": max(stats.tost_p(est[a]["value"], est[a]["se"], tost_threshold) for a in at), "tost_threshold": tost_threshold}


def window_test(fit: FitResult, tost_threshold: float | None = None) -> dict:
    """Placebo or carryover test: the masked window's mean effect, its se over replicates, p and TOST p."""
    kind, window = ("event", fit.options.placebo) if fit.options.placebo else ("exit", fit.options.carryover)
    if window is None:
        raise ValueError("the fit masks no window")
    inside = (F.col("kind") == kind) & F.col("at").between(*window)
    mean = (F.sum(F.col("value") * F.col("n_cells")) / F.sum("n_cells")).alias("value")
    value = fit.point().where(inside).agg(mean).first()[0]
    per = fit.replicates.where(inside & F.col("error").isNull()).groupBy("job_id").agg(mean)
    sd, n = per.agg(F.stddev_samp("value"), F.count("value")).first()
    se = sd * (n - 1) / np.sqrt(n) if fit.vartype == "jackknife" else sd
    if tost_threshold is None:
        tost_threshold = 0.36 * float(np.sqrt(fit.cells.where("ii = 1").agg(F.var_samp("eff")).first()[0]))
    return {"att": value, "se": se, "p_value": 2 * (1 - float(stats.norm_cdf(abs(value / se)))), "tost_p": stats.tost_p(value, se, tost_threshold)}


def _loo_job(p: jobs.Dense, kind: str, params: dict):
    at = params["at"]
    q = p.take(inference.draw(p, params["seed"])) if params["seed"] >= 0 else p
    hit = q.t_on == at
    got = jobs.fit_dense(q, use=q.use & ~hit, **params["fit"])
    e = (q.y - got.y0)[hit & q.obs]
    e = e[np.isfinite(e)]
    if not len(e):
        raise ValueError("no cell at the event time")
    return [("loo", float(at), float(e.mean()), len(e))]


def leave_one_period_out(fit: FitResult, nboots: int = 50, seed: int = 1) -> DataFrame:
    """att, se and p of each pre-period when its own cells are left out of the fit: a job for each period and replicate."""
    spark = fit.cells.sparkSession
    p = fit.panel or jobs.dense(fit.cells, tuple(f"x{i + 1}" for i in range(len(fit.spec.x))))
    arguments = inference._fit_arguments(fit.options, False)
    rows = [(i, "loo", {"at": at, "seed": s, "fit": arguments}) for i, (at, s) in enumerate(itertools.product(pre_periods(fit), [-1, *(seed * 7907 + b for b in range(nboots))]))]
    got = jobs.run(p, jobs.table(spark, rows), _loo_job, spark)
    point = F.col("job_id") % (nboots + 1) == 0
    out = got.where("error is null").groupBy(F.col("at").cast("int").alias("event_time")).agg(F.max(F.when(point, F.col("value"))).alias("att"), F.stddev_samp(F.when(~point, F.col("value"))).alias("se"))
    return out.withColumn("p_value", 2 * (1 - inference.normal_cdf(F.abs(F.col("att") / F.col("se")))))


def moderation_identified(cells: DataFrame, covariates: tuple[str, ...], moderators: tuple[str, ...], force: str = "two-way") -> dict:
    """n R^2 of the within residual on the linear terms' products with moderators: chi-squared if the moderation is linear."""
    p = jobs.dense(cells, covariates)
    use = p.use
    fitted, _ = jobs.kernels.least_squares_start(p.y, use, p.x, force)
    e = np.where(use, p.y - fitted, 0.0)
    index = [covariates.index(m) for m in moderators]
    terms = [p.x[:, :, i] * p.x[:, :, j] for i in range(len(covariates)) for j in index if j >= i]
    full = np.concatenate([p.x, np.stack(terms, axis=2)], axis=2)
    refit, _ = jobs.kernels.least_squares_start(e, use, full, force)
    n = int(use.sum())
    r2 = 1 - float(((e - refit)[use] ** 2).sum() / max((e[use] ** 2).sum(), 1e-300))
    return {"n_r2": n * max(r2, 0.0), "df": len(terms), "p_value": 1 - stats.chi2_cdf(n * max(r2, 0.0), len(terms))}


def refit_with(fit: FitResult, df: DataFrame, **changes) -> FitResult:
    """The same analysis with other options, for example a placebo window."""
    from .fit import fit as run

    return run(df, fit.spec, replace(fit.options, **changes), se=fit.replicates is not None, vartype=fit.vartype or "bootstrap")
