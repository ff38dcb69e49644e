"""The tables behind each plot; drawing is left to the reader's own tools."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import effects, panel
from . import diagnostics, estimands, moderation
from .fit import FitResult


def plot_data(fit: FitResult, kind: str, **options) -> DataFrame:
    """gap, equiv, exit, status, calendar, counterfactual, box, factors, loadings, loading_overlap, heterogeneous, cumul, sens."""
    aliases = {"ct": "counterfactual", "es": "gap", "hte": "heterogeneous"}
    kind = aliases.get(kind, kind)
    spark = fit.cells.sparkSession
    if kind in ("gap", "equiv", "exit"):
        name = "exit" if kind == "exit" else "event"
        rows = fit.intervals(0.90 if kind == "equiv" else 0.95) if fit.replicates is not None else fit.point()
        rows = rows.where(F.col("kind") == name).drop("kind").withColumnRenamed("at", "event_time")
        return rows.where("event_time <= 0") if kind == "equiv" else rows
    if kind == "status":
        return panel.status(fit.cells).select("unit", "time", "obs_status")
    if kind == "calendar":
        rows = sorted(effects.by_calendar(fit.cells).collect(), key=lambda r: r["time"])  # one row a period
        y, n = np.array([r["att"] for r in rows], float), np.array([r["n_cells"] for r in rows], float)
        smooth = stats.loess(np.arange(len(y)), y, n) if len(y) >= 4 else y
        data = [(i + 1, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, smooth, n, strict=True))]
        return spark.createDataFrame(data, "period int, att double, smooth double, n_cells long")
    if kind == "counterfactual":
        return effects.paths(fit.cells, options.get("staggered", True))
    if kind == "box":
        event = effects.by_event_time(fit.cells)
        top = event.agg(F.max("n_cells").alias("top"))
        enough = event.join(F.broadcast(top)).where(F.col("n_cells") >= F.lit(options.get("proportion", fit.options.proportion)) * F.col("top")).select("event_time")
        return fit.cells.where("eff is not null and t_on is not null").select(F.col("t_on").alias("event_time"), "unit", "eff").join(F.broadcast(enough), "event_time", "left_semi")
    if kind == "factors" and fit.times is not None:
        return fit.times
    if kind == "loadings" and fit.units is not None:
        return fit.units
    if kind == "loading_overlap" and fit.units is not None:
        ever = fit.cells.groupBy("unit").agg(F.max("ever").alias("ever"))
        return overlap(fit.units.join(ever, "unit"))
    if kind == "heterogeneous" and options.get("moderation"):
        return moderation.theta(fit, options["covariate"], options.get("at"))
    if kind == "heterogeneous":
        return effects.by_moderator(fit.cells, options["covariate"], options.get("bins"))
    if kind == "cumul":
        return estimands.estimand(fit, "att_cumu", "event_time", window=options.get("window"))
    if kind in ("sens", "sens_es"):
        return diagnostics.sensitivity(fit, by_period=kind == "sens_es", **options)
    raise ValueError(f"the fit has no data for a plot of {kind}")


#: Corners of a hull that may be broadcast.
MAX_CORNERS = 1_000_000


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in the plane, counter-clockwise; one or two where all points lie on a spot or a line."""
    points = np.unique(points, axis=0)  # sorted by the first coordinate, then the second
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def within(corners: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points lie in the hull, its border included: left of every edge."""
    if not len(corners):
        return np.zeros(len(points), bool)
    scale = 1e-9 * max(1.0, float(np.abs(corners).max()))
    inside = (points >= corners.min(axis=0) - scale).all(axis=1) & (points <= corners.max(axis=0) + scale).all(axis=1)
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        edge, length = b - a, float(np.hypot(*(b - a)))
        if length:
            inside &= (edge[0] * (points[:, 1] - a[1]) - edge[1] * (points[:, 0] - a[0])) / length >= -scale
    return inside


def control_hull(units: DataFrame) -> DataFrame:
    """(l1, l2): corners of the convex hull of the controls' first two loadings. Every task sends its own hull's corners."""

    def own(batches):
        rows = [np.stack(b["loadings"].to_list())[:, :2] for b in batches if len(b)]
        yield pd.DataFrame(hull(np.concatenate(rows)) if rows else np.zeros((0, 2)), columns=["l1", "l2"])

    parts = units.where("ever = 0 and loadings is not null").select("loadings").mapInPandas(own, "l1 double, l2 double")
    got = parts.limit(MAX_CORNERS + 1).toPandas()
    if len(got) > MAX_CORNERS:
        raise ValueError(f"more than {MAX_CORNERS} corners")
    return units.sparkSession.createDataFrame(pd.DataFrame(hull(got.to_numpy()), columns=["l1", "l2"]), "l1 double, l2 double")


def overlap(units: DataFrame) -> DataFrame:
    """unit, ever, l1, l2 and ``inside``: whether a unit's first two loadings lie in the convex hull of the controls', or, with one factor
    (l2 null), in their range."""
    first = units.where("loadings is not null").select(F.size("loadings").alias("n")).first()
    if first is None or first["n"] < 2:
        flat = units.select("unit", "ever", F.try_element_at("loadings", F.lit(1)).alias("l1"))
        span = flat.where("ever = 0").agg(F.min("l1").alias("low"), F.max("l1").alias("high"))
        return flat.join(F.broadcast(span)).select("unit", "ever", "l1", F.lit(None).cast("double").alias("l2"), F.col("l1").between(F.col("low"), F.col("high")).cast("int").alias("inside"))
    corners = units.sparkSession.sparkContext.broadcast(control_hull(units).toPandas().to_numpy())
    unit = units.schema["unit"].dataType.simpleString()

    def judged(batches):
        for b in batches:
            points = np.stack(b["loadings"].to_list())[:, :2] if len(b) else np.zeros((0, 2))
            yield pd.DataFrame({"unit": b["unit"], "ever": b["ever"], "l1": points[:, 0], "l2": points[:, 1], "inside": within(corners.value, points).astype(int)})

    return units.where("loadings is not null").select("unit", F.col("ever").cast("int").alias("ever"), "loadings").mapInPandas(judged, f"unit {unit}, ever int, l1 double, l2 double, inside int")



def event_study(table: DataFrame, period: str = "event_time", estimate: str = "att", se: str | None = "se", connected: bool = False, fill_gap: bool = True) -> DataFrame:
    """period, estimate, ci_low, ci_high from any table: missing intervals become estimate +- 1.96 se; gaps between
    integer periods are filled with nulls, or interpolated on half steps if ``connected``."""
    names = set(table.columns)
    low = F.col("ci_low") if "ci_low" in names else F.lit(None).cast("double")
    high = F.col("ci_high") if "ci_high" in names else F.lit(None).cast("double")
    spread = 1.96 * F.col(se) if se and se in names else F.lit(None).cast("double")
    rows = table.select(F.col(period).cast("double").alias("period"), F.col(estimate).cast("double").alias("estimate"), F.coalesce(low, F.col(estimate) - spread).alias("ci_low"), F.coalesce(high, F.col(estimate) + spread).alias("ci_high"))
    got = sorted(rows.collect(), key=lambda r: r["period"])  # one row a period
    if not got or not (connected or fill_gap):
        return rows
    at = np.array([r["period"] for r in got])
    grid = np.arange(at[0], at[-1] + 1e-9, 0.5 if connected else 1.0)
    out = []
    for g in grid.tolist():
        hit = np.flatnonzero(np.abs(at - g) < 1e-9)
        if len(hit):
            out.append(tuple(got[hit[0]]))
        elif connected:
            out.append((g, *(float(np.interp(g, at, [r[c] if r[c] is not None else np.nan for r in got])) for c in ("estimate", "ci_low", "ci_high"))))
        else:
            out.append((g, None, None, None))
    return table.sparkSession.createDataFrame(out, "period double, estimate double, ci_low double, ci_high double")
