"""Resampling: replicates as jobs, then standard errors, intervals and tests as aggregations over them."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import jobs
from .spec import FitOptions


def strata(p: jobs.Dense) -> list[np.ndarray]:
    """Treated units that stay treated, units that revert, and controls."""
    d = np.nan_to_num(p.d)
    ever, reverted = d.max(axis=0) > 0, (np.maximum.accumulate(d, axis=0) > d).any(axis=0)
    return [g for g in (np.flatnonzero(ever & ~reverted), np.flatnonzero(ever & reverted), np.flatnonzero(~ever)) if len(g)]


def draw(p: jobs.Dense, seed: int, tries: int = 50) -> np.ndarray:
    """Units drawn with replacement stratum by stratum, or whole clusters; draws that leave a period without a
    usable cell are rejected."""
    rng = np.random.default_rng(seed)
    clusters = [c for c in p.cluster if c is not None]
    for _ in range(tries):
        if clusters:
            names = sorted(set(clusters))
            picked = rng.choice(len(names), len(names))
            columns = np.concatenate([np.flatnonzero(np.array(p.cluster) == names[k]) for k in picked])
        else:
            columns = np.concatenate([rng.choice(g, len(g)) for g in strata(p)])
        if p.use[:, columns].any(axis=1).all() and (p.d[:, columns] == 1).any() and (np.nan_to_num(p.d[:, columns]).max(axis=0) == 0).any() >= (~p.ever).any():
            return columns
    raise ValueError("no feasible draw")


def _fit_arguments(options: FitOptions, weighted: bool) -> dict:
    return {"method": options.method, "force": options.force, "sample": options.sample, "r": options.r if isinstance(options.r, int) else 0, "lam": options.lam, "tol": options.tol, "max_iter": options.max_iter, "weighted": weighted, "bound": options.loading_bound, "gamma": options.gamma_loading, "solver": options.probit_solver}


def _resampled(p: jobs.Dense, kind: str, params: dict) -> jobs.Dense:
    if kind == "bootstrap":
        return p.take(draw(p, params["seed"]))
    if kind == "jackknife":
        return p.take(np.delete(np.arange(len(p.units)), params["leave"]))
    if kind == "parametric":
        return _parametric(p, params)
    return _permuted(p, params) if kind == "permute" else p


def _replicate(p: jobs.Dense, kind: str, params: dict):
    fit = params["fit"]
    p = _resampled(p, kind, params)
    got = jobs.fit_dense(p, **fit)
    rows = jobs.event_table(p, p.y - got.y0, fit["weighted"])
    return rows + [("marginal", float(k), float(v), int(p.use.sum())) for k, v in enumerate(got.extra.get("marginal", ()))]


def _surface(p: jobs.Dense, kind: str, params: dict):
    """(unit, times drawn, effects by period number) of the replicate's treated units; a unit drawn twice has the same effects twice."""
    p = _resampled(p, kind, params)
    eff = np.where(p.obs, p.y - jobs.fit_dense(p, **params["fit"]).y0, np.nan)
    at, drawn = np.array(p.index) - 1, Counter(p.units)
    for unit in drawn:
        k = p.units.index(unit)
        if (p.d[:, k] == 1).any():
            row = np.full(at[-1] + 1, np.nan)
            row[at] = eff[:, k]
            yield unit, drawn[unit], row.tolist()


def second_moments(paths: np.ndarray) -> np.ndarray:
    """Of rows that are error paths with gaps: the mean product of each two periods over the rows that have both."""
    seen = np.isfinite(paths)
    filled = np.where(seen, paths, 0.0)
    return filled.T @ filled / np.maximum(seen.T.astype(float) @ seen, 1.0)


def noise_factor(moments: np.ndarray) -> np.ndarray:
    """L with L L' the nearest positive semi-definite matrix: pairwise moments may have negative eigenvalues, which are set to zero."""
    values, vectors = np.linalg.eigh((moments + moments.T) / 2)
    return vectors * np.sqrt(np.maximum(values, 0.0))


def _valid_controls(p: jobs.Dense, r: int, unit_effects: bool) -> np.ndarray:
    """Controls observed often enough before the first adoption, and after the last, to stand for a treated unit."""
    onsets = np.argmax(p.d[:, p.ever] == 1, axis=0)
    before, after = p.obs[: onsets.min()].sum(axis=0), p.obs[onsets.max() + 1 :].sum(axis=0)
    short = onsets.max() + 1 >= len(p.times)  # nothing lies after the last adoption
    return np.flatnonzero(~p.ever & (before >= r + int(unit_effects)) & ((after >= 1) | short))


def _error_paths(p: jobs.Dense, kind: str, params: dict):
    """Prediction errors of one control in the place of every treated unit at once: copies of it, each with a treated unit's treatment,
    beside the other controls drawn with replacement, in one fit."""
    rng, fit = np.random.default_rng(params["seed"]), params["fit"]
    control, treated = np.flatnonzero(~p.ever), np.flatnonzero(p.ever)
    valid = _valid_controls(p, fit["r"], fit["force"] in ("unit", "two-way"))
    if not len(valid) or len(control) < 2:
        raise ValueError("no control can stand for a treated unit")
    fake = int(rng.choice(valid))
    rest = control[control != fake]
    for _ in range(50):
        others = rng.choice(rest, len(control))
        if p.use[:, others].any(axis=1).all():
            break
    else:
        raise ValueError("no feasible draw")
    q = p.take(np.concatenate([np.full(len(treated), fake), others]))
    q.d = q.d.copy()
    held = np.maximum.accumulate(np.nan_to_num(p.d[:, treated]), axis=0)  # treatment doesn't end where the treated unit itself isn't observed
    q.d[:, : len(treated)] = np.where(q.obs[:, : len(treated)], held, np.nan)
    q.use = q.obs & ~(q.d == 1)
    error = np.where(q.obs, q.y - jobs.fit_dense(q, **fit).y0, np.nan)
    for k in range(len(treated)):
        yield k, error[:, k].tolist()


def _drawn_paths(gaps: bool, nboots: int, seed: int):
    """For one treated unit: an error path for each draw, out of its simulated ones where nothing is missing, else normal with their moments."""

    def draw_paths(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["k"].iloc[0])
        rng = np.random.default_rng([seed, k])
        paths = np.stack(rows.sort_values("job_id")["path"].to_list()).astype(float)
        if gaps:
            drawn = rng.standard_normal((nboots, paths.shape[1])) @ noise_factor(second_moments(paths)).T
        else:
            drawn = paths[rng.integers(0, len(paths), nboots)]
        return pd.DataFrame({"job_id": np.arange(nboots), "k": k, "path": list(drawn)})

    return draw_paths


def _parametric_paths(p: jobs.Dense, options: FitOptions, spark, nboots: int, seed: int, weighted: bool) -> tuple[jobs.Dense, DataFrame]:
    """The panel with what draws need beside it, and (job_id, k, path): the errors of the k-th treated unit in each draw.

    First a fit of the panel as a job; then one job a draw that simulates prediction errors for all treated units; then a group a
    treated unit, whose paths are resampled or summed up in second moments. Draws themselves fit only their own outcome."""
    fit = _fit_arguments(options, weighted)
    got = jobs.fit_remote(p, spark, **fit)
    gaps = not bool(p.obs.all())
    residual = np.where(p.obs, p.y - got.y0, np.nan)[:, ~p.ever]
    whole = replace(p, fitted=got.y0, noise=noise_factor(second_moments(residual.T)) if gaps else None)
    made = jobs.table(spark, [(i, "errors", {"seed": seed * 104729 + i, "fit": fit}) for i in range(nboots)])
    errors = jobs.run_paths(p, made, _error_paths, spark).where("error is null")
    return whole, errors.groupBy("k").applyInPandas(_drawn_paths(gaps, nboots, seed), "job_id long, k int, path array<double>")


def _parametric(p: jobs.Dense, params: dict) -> jobs.Dense:
    """Fitted outcomes plus drawn errors: treated units' from ``paths``, and controls drawn with replacement, whose errors are other controls'
    residual paths, or normal with the residuals' second moments where cells are missing. Effects are added to treated cells."""
    rng = np.random.default_rng(params["seed"])
    control, treated = np.flatnonzero(~p.ever), np.flatnonzero(p.ever)
    if len(params["paths"]) < len(treated):
        raise ValueError("no error path was simulated")
    for _ in range(50):
        others = rng.choice(control, len(control))
        if p.use[:, others].any(axis=1).all():
            break
    else:
        raise ValueError("no feasible draw")
    columns = np.concatenate([treated, others])
    out = p.take(columns)
    if p.noise is None:
        error = np.where(p.obs, p.y - p.fitted, 0.0)[:, rng.choice(control, len(control))]
    else:
        error = p.noise @ rng.standard_normal((p.noise.shape[1], len(control)))
    errors = np.concatenate([np.stack([params["paths"][k] for k in range(len(treated))], axis=1), error], axis=1)
    eff = np.where(out.d == 1, out.y - p.fitted[:, columns], 0.0)
    out.y = np.where(out.obs, p.fitted[:, columns] + np.nan_to_num(errors) + np.nan_to_num(eff), np.nan)
    return out


def _permuted(p: jobs.Dense, params: dict) -> jobs.Dense:
    """Treatment moved to other units (``units``) or its periods shuffled in blocks of length m."""
    rng = np.random.default_rng(params["seed"])
    out = p.take(np.arange(len(p.units)))
    if params.get("units"):
        order = rng.permutation(len(p.units))
        out.d = np.where(np.isnan(p.d), np.nan, p.d[:, order])
    else:
        t, m = p.d.shape[0], params.get("m", 2)
        blocks = [np.arange(a, min(a + m, t)) for a in range(0, t, m)]
        rows = np.concatenate([blocks[k] for k in rng.permutation(len(blocks))])
        out.d = np.where(np.isnan(p.d), np.nan, np.nan_to_num(p.d)[rows])
    out.use = out.obs & ~(out.d == 1)
    return out


def _jobs(p: jobs.Dense, options: FitOptions, vartype: str, nboots: int, seed: int, weighted: bool) -> list[tuple[int, str, dict]]:
    fit = _fit_arguments(options, weighted)
    if vartype == "jackknife":
        return [(i, "jackknife", {"leave": i, "fit": fit}) for i in range(len(p.units))]
    if vartype in ("bootstrap", "parametric"):
        return [(i, vartype, {"seed": seed * 100003 + i, "fit": fit}) for i in range(nboots)]
    raise ValueError("vartype is bootstrap, jackknife or parametric")


def replicates(p: jobs.Dense, options: FitOptions, spark, vartype: str = "bootstrap", nboots: int = 200, seed: int = 1, weighted: bool = False) -> DataFrame:
    """(job_id, kind, at, value, n_cells, error) of every replicate. Tuned parameters are reused, never re-chosen."""
    p, paths = _parametric_paths(p, options, spark, nboots, seed, weighted) if vartype == "parametric" else (p, None)
    return jobs.run(p, jobs.table(spark, _jobs(p, options, vartype, nboots, seed, weighted)), _replicate, spark, paths)


def surfaces(p: jobs.Dense, options: FitOptions, spark, unit_type: str, vartype: str = "bootstrap", nboots: int = 200, seed: int = 1, weighted: bool = False) -> DataFrame:
    """(job_id, unit, n_drawn, effects, error): the surfaces of the same replicates, a row for each treated unit drawn."""
    p, paths = _parametric_paths(p, options, spark, nboots, seed, weighted) if vartype == "parametric" else (p, None)
    return jobs.run_surfaces(p, jobs.table(spark, _jobs(p, options, vartype, nboots, seed, weighted)), _surface, spark, unit_type, paths)


def intervals(point: DataFrame, reps: DataFrame, vartype: str, level: float = 0.95, method: str = "normal") -> DataFrame:
    """se, interval and two-sided p of every estimate. ``normal`` is symmetric; ``basic`` reflects the replicates'
    quantiles around the row's own estimate; ``percentile`` takes them as they are. Jackknife standard errors come from
    pseudo-values; failed replicates are left out."""
    a = (1 - level) / 2
    good = reps.where("error is null and not isnan(value)")
    per = good.groupBy("kind", "at").agg(
        F.stddev_samp("value").alias("sd"), F.count("value").alias("n_reps"), F.percentile("value", F.array(F.lit(a), F.lit(1 - a))).alias("q"),
        F.avg((F.col("value") <= 0).cast("double")).alias("below"))
    total = reps.agg(F.count_distinct("job_id").alias("n_jobs"))
    out = point.join(per, ["kind", "at"], "left").join(F.broadcast(total))
    if vartype == "jackknife":
        out = out.withColumn("se", F.col("sd") * (F.col("n_jobs") - 1) / F.sqrt("n_reps"))
    else:
        out = out.withColumn("se", F.col("sd"))
    z = stats.norm_ppf(1 - a)
    if method == "normal" or vartype == "jackknife":
        out = out.withColumn("ci_low", F.col("value") - z * F.col("se")).withColumn("ci_high", F.col("value") + z * F.col("se"))
    elif method == "basic":
        out = out.withColumn("ci_low", 2 * F.col("value") - F.col("q")[1]).withColumn("ci_high", 2 * F.col("value") - F.col("q")[0])
    elif method == "percentile":
        out = out.withColumn("ci_low", F.col("q")[0]).withColumn("ci_high", F.col("q")[1])
    else:
        raise ValueError("method is normal, basic or percentile")
    if vartype == "jackknife":

        p = 2 * (1 - normal_cdf(F.abs(F.col("value") / F.col("se"))))
    else:
        p = 2 * F.least("below", 1 - F.col("below"))
    return out.withColumn("p_value", F.least(p, F.lit(1.0))).select("kind", "at", "value", "n_cells", "se", "ci_low", "ci_high", "p_value", "n_reps")


def normal_cdf(x):
    """Standard normal distribution function of a non-negative column (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    u = x / float(np.sqrt(2))
    t = 1 / (1 + 0.3275911 * u)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-u * u)
    return 1 - tail / 2


def covariance(reps: DataFrame, kind: str = "event") -> DataFrame:
    """(at_a, at_b, cov): pairwise-complete covariance of the event-time effects over replicates."""
    good = reps.where((F.col("kind") == kind) & F.col("error").isNull()).select("job_id", "at", "value")
    other = good.select("job_id", F.col("at").alias("at_b"), F.col("value").alias("value_b"))
    return good.join(other, "job_id").groupBy(F.col("at").alias("at_a"), "at_b").agg(F.covar_samp("value", "value_b").alias("cov"))


def permutation_test(p: jobs.Dense, options: FitOptions, spark, n: int = 200, m: int = 2, units: bool = False, seed: int = 1) -> DataFrame:
    """att, p_value: the share of permuted treatments whose overall effect is at least as large in size."""
    fit = _fit_arguments(options, False)
    rows = [(-1, "point", {"fit": fit})] + [(i, "permute", {"seed": seed * 7919 + i, "m": m, "units": units, "fit": fit}) for i in range(n)]
    got = jobs.run(p, jobs.table(spark, rows), _replicate, spark).where("kind = 'overall'")
    own = got.where("job_id = -1").select(F.col("value").alias("att"))
    return got.where("job_id >= 0").join(F.broadcast(own)).groupBy("att").agg(F.avg((F.abs("value") >= F.abs("att")).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("n_permutations"))
