"""``fit``: from a table and a specification to relations of cells, effects and replicates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import information
from ..operators import additive, effects, event_time, factors, panel
from ..sources.stored import stored
from . import cv, inference, jobs, leave_one_out
from .spec import FitOptions, PanelSpec


@dataclass
class FitResult:
    """Normalised output: each attribute is a relation or a plain number."""

    spec: PanelSpec
    options: FitOptions
    cells: DataFrame
    scalars: dict = field(default_factory=dict)
    units: DataFrame | None = None
    times: DataFrame | None = None
    panel: jobs.Dense | None = None
    replicates: DataFrame | None = None
    vartype: str | None = None
    #: The replicates' surfaces (job_id, unit, n_drawn, effects by period number), if they were kept; None for the closed jackknife, whose
    #: surface follows from the cells.
    surface: DataFrame | None = None
    keeps_surface: bool = False

    def event(self, on: str = "t_on") -> DataFrame:
        return effects.by_event_time(self.cells, on, weighted=self.options.weight_agg and (self.spec.weight or self.spec.agg_weight) is not None)

    def overall(self) -> DataFrame:
        return effects.overall(self.cells)

    def calendar(self) -> DataFrame:
        return effects.by_calendar(self.cells)

    def group(self) -> DataFrame:
        return effects.by_group(self.cells)

    def test_window(self) -> DataFrame:
        """The placebo or carryover test's effect."""
        if self.options.placebo:
            return effects.in_window(self.cells, "t_on", self.options.placebo)
        if self.options.carryover:
            return effects.in_window(self.cells, "t_off", self.options.carryover)
        raise ValueError("the fit masks no placebo or carryover window")

    def intervals(self, level: float = 0.95, method: str = "normal") -> DataFrame:
        if self.replicates is None:
            raise ValueError("the fit has no replicates")
        return inference.intervals(self.point(), self.replicates, self.vartype, level, method)

    def point(self) -> DataFrame:
        """(kind, at, value, n_cells) of the fit itself, in the replicates' layout."""
        eff = self.cells.where("eff is not null")
        parts = [eff.where("d = 1").agg(F.lit("overall").alias("kind"), F.lit(0.0).alias("at"), F.avg("eff").alias("value"), F.count("eff").alias("n_cells"))]
        for kind, column in (("event", "t_on"), ("exit", "t_off")):
            parts.append(eff.where(F.col(column).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(column).cast("double").alias("at")).agg(F.avg("eff").alias("value"), F.count("eff").alias("n_cells")))
        parts.append(eff.where("d = 1").groupBy(F.lit("calendar").alias("kind"), F.col("time_ix").cast("double").alias("at")).agg(F.avg("eff").alias("value"), F.count("eff").alias("n_cells")))
        marginal = [("marginal", float(k), self.scalars[f"marginal_{name}"]) for k, name in enumerate(self.spec.x) if f"marginal_{name}" in self.scalars]
        if marginal:
            made = self.cells.sparkSession.createDataFrame(marginal, "kind string, at double, value double")
            parts.append(made.join(F.broadcast(self.cells.where("ii = 1").agg(F.count(F.lit(1)).alias("n_cells")))))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def summary(self) -> DataFrame:
        spark = self.cells.sparkSession
        return spark.createDataFrame([(k, float(v)) for k, v in self.scalars.items() if np.isscalar(v) and v is not None], "name string, value double")


def _additive(cells: DataFrame, spec: PanelSpec, options: FitOptions) -> bool:
    """Whether the model is one of unit and period effects alone: no factors, and further effects only of unions of units."""
    if options.force != "two-way" or options.sample != "notyettreated" or options.r != 0 or options.method not in ("ife", "cfe") or (options.method == "cfe" and (spec.z or spec.q)):
        return False
    extra = [f"fe{i + 1}" for i in range(len(spec.extra_fe))] if options.method == "cfe" else []
    if not extra:
        return True
    several = cells.where("ii = 1").groupBy("unit").agg(*(F.size(F.collect_set(F.coalesce(c, F.lit("?")))).alias(c) for c in extra))
    return several.where(" or ".join(f"{c} > 1" for c in extra)).limit(1).count() == 0


def _spread(cells: DataFrame, options: FitOptions, x: tuple[str, ...], weighted: bool, select: bool, se: bool) -> bool:
    """Whether a factor or penalised model is fitted over the units' rows."""
    ready = not select and options.sample == "notyettreated" and options.force in factors.FORCES and ((options.method == "ife" and isinstance(options.r, int) and options.r > 0) or (options.method == "mc" and options.lam is not None))
    if options.distributed and not ready:
        raise ValueError("distributed fits need ife with a rank, or mc with a penalty, on not-yet-treated cells")
    never = not select and options.sample == "nevertreated" and options.force in factors.FORCES and options.method == "ife" and isinstance(options.r, int) and options.r > 0 and not weighted and options.loading_bound == "none"
    return (ready and options.distributed) or ((ready or never) and _large(cells, x, se))


def _large(cells: DataFrame, x: tuple[str, ...], se: bool) -> bool:
    return not se and jobs.dense_bytes(cells, len(x)) > min(jobs.DRIVER_BYTES, jobs.MAX_PANEL_BYTES)


def fit(df: DataFrame, spec: PanelSpec, options: FitOptions | None = None, se: bool = False, vartype: str = "bootstrap", nboots: int = 200, seed: int = 1, select: bool = False, folds: int = 10, checked: bool = True, keep_surface: bool = False) -> FitResult:
    """Fit the untreated outcome on untreated cells, impute it everywhere, and optionally resample.

    ``keep_surface`` stores each replicate's surface for intervals of filtered estimands. Additive models stay in the cluster: means by SQL, two-way effects by exact least squares, the never-treated closed
    form where controls are balanced or ``control_means`` asks for it. Factor models run as kernels over the dense panel."""
    options = (options or FitOptions()).resolved()
    if options.method == "probit" and df.where(F.col(spec.y).isNotNull() & ~F.col(spec.y).cast("double").isin(0.0, 1.0)).limit(1).count():
        raise ValueError("probit needs an outcome of 0 and 1")
    if se and vartype == "parametric" and (options.method in ("mc", "both") or options.sample == "notyettreated"):
        raise ValueError("the parametric bootstrap needs a factor or additive model on never-treated units")
    if checked:
        panel.check(df, spec)
    cells = stored(panel.prepare(df, spec, options), "unit")  # many plans read it; a written table also keeps them short
    if checked:
        panel.check_occupancy(cells, options)
    if se and vartype == "parametric" and event_time.has_reversals(cells):
        raise ValueError("the parametric bootstrap needs treatment that doesn't end")
    x = tuple(f"x{i + 1}" for i in range(len(spec.x)))
    scale = 1.0
    if options.normalize:
        # outcome and covariates in units of the outcome's standard deviation; what comes out is scaled back
        scale = float(cells.agg(F.stddev_samp("y")).first()[0] or 1.0)
        cells = cells.withColumns({c: F.col(c) / scale for c in ("y", *x)})
    weighted = options.weight_fit and spec.weight is not None
    scalars: dict = {}
    dense: jobs.Dense | None = None
    units = times = None
    closed = options.method == "fe" and options.sample == "nevertreated" and not x and not weighted and (options.control_means or additive.controls_balanced(cells))
    if closed:
        out = additive.never_treated(cells, options.force)
    elif options.method == "fe" and options.force != "two-way" and not x and not weighted and options.sample == "notyettreated":
        out = additive.with_means(cells, options.force)
    elif options.method == "fe" and options.force == "two-way" and options.sample == "notyettreated":
        out, info = additive.exact_fit(cells, x, weighted)
        scalars |= {f"beta_{spec.x[i]}": float(b) for i, b in enumerate(info["beta"])}
    elif not select and not options.distributed and _additive(cells, spec, options) and _large(cells, x, se):
        out, info = additive.exact_fit(cells, x, weighted)
        scalars |= {f"beta_{spec.x[i]}": float(b) for i, b in enumerate(info["beta"])}
        used = out.where("ii = 1").agg(F.sum((F.col("y") - F.col("y0")) ** 2), F.count(F.lit(1)), F.count_distinct("unit"), F.count_distinct("time_ix")).first()
        sigma2, ic, pc = information(used[0], used[1], used[3], used[2], 0, len(x), options.force)
        scalars |= {"sigma2": sigma2, "ic": ic, "pc": pc, "converged": 1.0}
    elif _spread(cells, options, x, weighted, select, se):
        out, sides, loadings = factors.fit(cells, x, options.r if options.method == "ife" else 0, options.lam if options.method == "mc" else None, options.force, weighted, options.tol, options.max_iter, options.sample == "nevertreated")
        r = options.r if options.method == "ife" else 0
        sigma2, ic, pc = information(sides.ssr, sides.n_cells, len(sides.xi), sides.n_units, r, len(x), options.force) if r else (sides.ssr / max(sides.n_cells, 1), np.nan, np.nan)
        scalars |= {"sigma2": sigma2, "ic": ic, "pc": pc, "n_iter": sides.n_iter, "converged": float(sides.converged)} | {f"beta_{spec.x[i]}": float(b) for i, b in enumerate(sides.beta)}
        units, times = loadings, cells.sparkSession.createDataFrame([(i + 1, row) for i, row in enumerate(sides.factors.tolist())], "time_ix int, factors array<double>")
    else:
        dense = jobs.dense(cells, x)
        r, lam, method = options.r, options.lam, options.method
        if select or isinstance(r, tuple) or (method in ("mc", "both") and lam is None):
            chosen = cv.choose(dense, options, cells.sparkSession, folds=folds, seed=seed, rule=options.cv_rule, kind=options.cv_method)
            r, lam, method = chosen["r"], chosen["lam"], chosen["method"]
            scalars |= {"r_cv": r, "lambda_cv": lam if lam is not None else float("nan")}
        options = replace(options, method=method, r=r, lam=lam)
        got = jobs.fit_remote(dense, cells.sparkSession, method=method, force=options.force, sample=options.sample, r=r, lam=lam, tol=options.tol, max_iter=options.max_iter, weighted=weighted, bound=options.loading_bound, gamma=options.gamma_loading, solver=options.probit_solver)
        scalars |= {"sigma2": got.sigma2, "ic": got.ic, "pc": got.pc, "n_iter": got.n_iter, "converged": float(got.converged)} | {f"beta_{spec.x[i]}": float(b) for i, b in enumerate(got.beta)}
        scalars |= {f"marginal_{spec.x[i]}": float(v) for i, v in enumerate(got.extra.get("marginal", ()))}
        spark = cells.sparkSession
        t, n = got.y0.shape
        index = sorted({r["time_ix"] for r in cells.select("time_ix").distinct().collect()})
        kind = cells.schema["unit"].dataType.simpleString()
        # a row a unit travels, as Arrow columns
        table = pa.table({"unit": pa.array(dense.units), "v": pa.array([None if not np.isfinite(c).any() else c for c in got.y0.T], pa.list_(pa.float64()))})
        y0 = spark.createDataFrame(table).select(F.col("unit").cast(kind).alias("unit"), "v")
        at = F.array_position(F.array(*(F.lit(i) for i in index)), F.col("time_ix")).cast("int")
        out = cells.join(y0, "unit", "left").withColumn("y0", F.nanvl(F.try_element_at("v", at), F.lit(None).cast("double"))).drop("v")
        if got.factors is not None and got.loadings is not None:
            units = spark.createDataFrame([(u, [float(v) for v in got.loadings[i]]) for i, u in enumerate(dense.units)], f"unit {kind}, loadings array<double>")
            times = spark.createDataFrame([(index[i], [float(v) for v in got.factors[i]]) for i in range(t)], "time_ix int, factors array<double>")
    if options.normalize:
        out = out.withColumns({c: F.col(c) * scale for c in ("y", "y0", *x)})
        scalars |= {"sigma2": scalars["sigma2"] * scale**2} if "sigma2" in scalars else {}
    result = FitResult(spec, options, effects.with_effect(out), scalars, units, times, dense)
    if se:
        result.vartype, result.keeps_surface = vartype, keep_surface
        if vartype == "jackknife" and closed and options.force == "two-way":
            result.cells = stored(result.cells, "unit")
            result.replicates = leave_one_out.replicates(result.cells)
            return result
        result.panel = dense or jobs.dense(cells, x)
        result.replicates = inference.replicates(result.panel, options, cells.sparkSession, vartype, nboots, seed, weighted)
        if keep_surface:
            unit_type = cells.schema["unit"].dataType.simpleString()
            result.surface = stored(inference.surfaces(result.panel, options, cells.sparkSession, unit_type, vartype, nboots, seed, weighted), "job_id")
        if options.normalize:
            result.replicates = result.replicates.withColumn("value", F.col("value") * scale)
            if keep_surface:
                result.surface = result.surface.withColumn("effects", F.transform("effects", lambda e: e * scale))
    return result
