"""The counterfactual surface as a table, and estimands over it with their replicates' uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import effects, event_time
from . import inference, leave_one_out
from .fit import FitResult

SHIPPED = {"att": ("event_time", "overall", "calendar_time", "cohort"), "att_cumu": ("event_time", "overall"), "aptt": ("event_time",), "log_att": ("event_time",)}


def predicate(cells: str | Column | None) -> Column:
    """A filter over the surface, as a column, an SQL text, or a one-sided formula ``"~ x > 1"``."""
    if cells is None:
        return F.lit(True)
    if isinstance(cells, str):
        return F.expr(cells.lstrip().removeprefix("~"))
    return cells


def imputed_outcomes(fit: FitResult, cells: str | Column | None = None, direction: str = "on", replicates: bool = False) -> DataFrame:
    """unit, time, event_time, cohort, treated, y, y0, eff, w: one row for each observed cell with a counterfactual.

    With ``replicates``, the rows of treated units once for every replicate that holds the unit: job_id, n_drawn (how often the replicate
    drew the unit), eff and y0 are the replicate's, all else the cell's own; the closed jackknife's rows also name the unit left_out. The filter sees the fit's own rows and comes first, so that
    the replicates' surface is read for what it keeps alone."""
    rows = fit.cells.where("eff is not null")
    if direction == "on":
        rows = rows.withColumn("cohort", event_time.first_treated()).withColumn("event_time", F.col("t_on"))
    else:
        # a unit's exit cohort is the period at which its first exit counts 1
        exit_period = F.min(F.when(F.col("t_off") == 1, F.col("time_ix"))).over(W.partitionBy("unit"))
        rows = rows.withColumn("event_time", F.col("t_off")).withColumn("cohort", exit_period)
    out = rows.select("unit", "time", "time_ix", "event_time", "cohort", (F.coalesce("d", F.lit(0)) == 1).alias("treated"), "y", "y0", "eff", "w", "g", *[c for c in rows.columns if c.startswith("x") and c[1:].isdigit()])
    out = out.where(predicate(cells))
    return _expanded(fit, out) if replicates else out


def _expanded(fit: FitResult, rows: DataFrame) -> DataFrame:
    if not fit.keeps_surface:
        raise ValueError("the fit kept no surface of its replicates: fit with se=True and keep_surface=True")
    treated = fit.cells.where("d = 1").select("unit").distinct()
    rows = rows.join(treated, "unit", "left_semi")
    if fit.surface is None:
        met = leave_one_out.cell_replicates(fit.cells, rows)
    else:
        met = rows.drop("eff").join(fit.surface.where("unit is not null").select("job_id", "unit", "n_drawn", "effects"), "unit")
        met = met.withColumn("eff", F.nanvl(F.get("effects", F.col("time_ix") - 1), F.lit(None).cast("double"))).drop("effects")
    return met.where("eff is not null").withColumn("y0", F.col("y") - F.col("eff"))


def estimand(fit: FitResult, kind: str = "att", by: str = "event_time", cells: str | Column | None = None, window: tuple[int, int] | None = None, direction: str = "on") -> DataFrame:
    """The estimand's table. ``window`` limits event times; combinations that no definition covers raise."""
    if kind not in SHIPPED or by not in SHIPPED[kind]:
        raise ValueError(f"no estimand {kind} by {by}; there are {SHIPPED}")
    rows = imputed_outcomes(fit, cells, direction)
    if window is not None:
        rows = rows.where(F.col("event_time").between(*window))
    long = rows.withColumn("d", F.col("treated").cast("int")).withColumn("t_on", F.col("event_time"))
    if kind == "att":
        if by == "event_time":
            return effects.by_event_time(long)
        key = {"overall": [], "calendar_time": ["time"], "cohort": ["cohort"]}[by]
        return long.where("d = 1 and t_on is not null").groupBy(*key).agg(F.avg("eff").alias("att"), F.count("eff").alias("n_cells"))
    if kind == "aptt":
        return effects.proportional(long)
    if kind == "log_att":
        return effects.logarithmic(long)
    event = effects.by_event_time(long.where("d = 1"))
    bounds = window or (1, 10**6)
    out = effects.cumulative(event, bounds)
    return out if by == "event_time" else out.orderBy(F.col("event_time").desc()).limit(1)


def _at(by: str) -> Column:
    return {"overall": F.lit(0.0), "event_time": F.col("event_time"), "calendar_time": F.col("time_ix"), "cohort": F.col("cohort")}[by].cast("double")


def _left_out(fit: FitResult, rows: DataFrame, kind: str, by: str) -> DataFrame:
    """(job_id, at, value, n_cells) of the closed jackknife's replicates, from what each unit moves sums by: cells and replicates are never paired."""
    treated = fit.cells.where("d = 1").select("unit").distinct()
    rows = rows.join(treated, "unit", "left_semi").select("unit", "time_ix", _at(by).alias("at"), "eff", "y", "y0")
    if kind == "log_att":
        out = leave_one_out.log_sums(fit.cells, rows.drop("eff"))
        value = F.col("s") / F.col("n")
    else:
        out = leave_one_out.sums(fit.cells, rows.drop("y0").withColumn("kind", F.lit(kind)))
        value = F.col("s") / (F.nullif(F.col("sy") - F.col("s"), F.lit(0.0)) if kind == "aptt" else F.col("n"))
    return out.select("job_id", "at", value.alias("value"), F.col("n").cast("long").alias("n_cells"))


def _aggregated(rows: DataFrame, kind: str, by: str) -> DataFrame:
    """(job_id, at, value, n_cells) of an estimand over replicate rows; a unit counts as often as it was drawn."""
    at = _at(by)
    n = F.col("n_drawn")
    if kind == "log_att":
        # cells whose outcome or counterfactual has no logarithm are left out
        rows = rows.where("y > 0 and y0 > 0").withColumn("value", F.log("y") - F.log("y0"))
        top, bottom = F.sum(n * F.col("value")), F.sum(n)
    elif kind == "aptt":
        top, bottom = F.sum(n * F.col("eff")), F.sum(n * F.col("y0"))
    else:
        top, bottom = F.sum(n * F.col("eff")), F.sum(n)
    return rows.groupBy("job_id", at.alias("at")).agg((top / F.nullif(bottom.cast("double"), F.lit(0.0))).alias("value"), F.sum(n).cast("long").alias("n_cells"))


def estimand_intervals(fit: FitResult, kind: str = "att", by: str = "event_time", cells: str | Column | None = None, window: tuple[int, int] | None = None, direction: str = "on", level: float = 0.95, method: str = "basic") -> DataFrame:
    """at, value, n_cells, se, ci_low, ci_high, p_value and n_reps of an estimand, on any filter or window, from the replicates' surface.

    ``at`` is the event time, the number of the calendar period, the cohort's first period, or 0 overall. Replicates in which no cell of the
    estimand is left are failed ones. Only treated cells count; without a filter, event times before treatment too for the effect itself."""
    if kind not in SHIPPED or by not in SHIPPED[kind]:
        raise ValueError(f"no estimand {kind} by {by}; there are {SHIPPED}")
    needed = F.col("event_time").isNotNull() & (F.col("treated") if kind != "att" or by != "event_time" else F.lit(True))
    if window is not None:
        needed = needed & F.col("event_time").between(*window)
    elif kind == "att_cumu":
        needed = needed & (F.col("event_time") >= 1)
    chosen = predicate(cells) & needed
    own = imputed_outcomes(fit, chosen, direction).withColumn("job_id", F.lit(0).cast("long")).withColumn("n_drawn", F.lit(1))
    if not fit.keeps_surface:
        raise ValueError("the fit kept no surface of its replicates: fit with se=True and keep_surface=True")
    inner = "event_time" if kind == "att_cumu" else by

    every = (fit.cells.select(F.xxhash64("unit").alias("job_id")) if fit.surface is None else fit.surface.select("job_id")).distinct()

    def aggregated(rows: DataFrame | None) -> DataFrame:
        """(job_id, at, value, n_cells) of the rows, or of the replicates."""
        out = _aggregated(rows, "att" if kind == "att_cumu" else kind, inner) if rows is not None else _left_out(fit, own, kind, inner)
        if kind != "att_cumu":
            return out
        order = W.partitionBy("job_id").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
        value = F.sum(F.col("value") * F.col("n_cells")).over(order) / F.sum("n_cells").over(order) * F.count(F.lit(1)).over(order)
        out = out.select("job_id", "at", value.alias("value"), "n_cells")
        if by == "event_time":
            return out
        return out.groupBy("job_id").agg(F.lit(0.0).alias("at"), F.max_by("value", "at").alias("value"), F.sum("n_cells").alias("n_cells"))

    point = aggregated(own).select(F.lit(kind).alias("kind"), "at", "value", "n_cells")
    reps = every.join(aggregated(None if fit.surface is None else imputed_outcomes(fit, chosen, direction, replicates=True)), "job_id", "left").select("job_id", F.lit(kind).alias("kind"), "at", "value", "n_cells", F.when(F.col("value").isNull(), "no cell").alias("error"))
    return inference.intervals(point, reps, fit.vartype, level, method).drop("kind")


def with_uncertainty(fit: FitResult, level: float = 0.95, method: str = "basic") -> DataFrame:
    """The event-time and overall effects with intervals from the fit's replicates. Each replicate is aggregated with
    its own treatment and event times, so resampled units never borrow another unit's cells."""
    return inference.intervals(fit.point().where(F.col("kind").isin("event", "overall")), fit.replicates, fit.vartype, level, method)


def cumulative_with_uncertainty(fit: FitResult, window: tuple[int, int], level: float = 0.95, method: str = "percentile") -> DataFrame:
    """Cumulative effects up to each event time of the window, each replicate cumulated on its own."""
    def cumulated(rows: DataFrame, *key: str) -> DataFrame:
        order = W.partitionBy(*key, F.lit(1)).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.where((F.col("kind") == "event") & F.col("at").between(*window))
        value = F.sum(F.col("value") * F.col("n_cells")).over(order) / F.sum("n_cells").over(order) * F.count(F.lit(1)).over(order)
        return rows.withColumn("__c", value).drop("value").withColumnRenamed("__c", "value")

    return inference.intervals(cumulated(fit.point()), cumulated(fit.replicates, "job_id"), fit.vartype, level, method)
