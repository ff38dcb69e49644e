"""Treatment effects from cells with a counterfactual: one grouped aggregation each.

``cells`` has y, y0, d, i_obs, w, t_on, t_off, time_ix, unit and g; ``eff`` is y - y0 where the cell is observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

def with_effect(cells: DataFrame) -> DataFrame:
    return cells.withColumn("eff", F.when(F.col("i_obs") == 1, F.col("y") - F.col("y0")))


def _treated() -> Column:
    return F.col("d") == 1


def _weighted(cells: DataFrame, value: Column, on: Column | None = None) -> Column:
    """The mean of a value by the cells' own weights of aggregation (wa), or by w where they have none."""
    use = F.col("eff").isNotNull() if on is None else on & F.col("eff").isNotNull()
    weight = F.col("wa" if "wa" in cells.columns else "w")
    return F.sum(F.when(use, value * weight)) / F.nullif(F.sum(F.when(use, weight)), F.lit(0.0))


def overall(cells: DataFrame) -> DataFrame:
    """att_avg, att_avg_w, n_treated, rmse of treated units' untreated cells."""
    on = _treated()
    fit_cell = (F.col("ever") == 1) & (F.coalesce(F.col("d"), F.lit(0)) == 0) & (F.col("ii") == 1)
    return cells.agg(
        F.avg(F.when(on, F.col("eff"))).alias("att_avg"), _weighted(cells, F.col("eff"), on).alias("att_avg_w"), F.count(F.when(on, F.col("eff"))).alias("n_treated"),
        F.sqrt(F.avg(F.when(fit_cell, F.col("eff") ** 2))).alias("rmse"))


def unit_average(cells: DataFrame, na_robust: bool = False) -> DataFrame:
    """att_avg_unit: the mean over treated units of their mean effect. A unit with a missing effect among its treated
    cells doesn't count, unless ``na_robust``."""
    per = cells.where("d = 1").groupBy("unit").agg(F.avg("eff").alias("m"), F.count(F.when(F.col("eff").isNull(), 1)).alias("gaps"))
    return (per if na_robust else per.where("gaps = 0")).agg(F.avg("m").alias("att_avg_unit"), F.count("m").alias("n_units"))


def by_event_time(cells: DataFrame, on: str = "t_on", weighted: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """att and n_cells (and att_w) for each value of the event time ``on``; before entry these are in-sample residuals."""
    aggregates = [F.avg("eff").alias("att"), F.count("eff").alias("n_cells")]
    if weighted:
        aggregates.append(_weighted(cells, F.col("eff")).alias("att_w"))
    return cells.where(F.col(on).isNotNull()).groupBy(*keys, F.col(on).alias("event_time")).agg(*aggregates)


def by_calendar(cells: DataFrame) -> DataFrame:
    return cells.where("d = 1").groupBy("time").agg(F.avg("eff").alias("att"), F.count("eff").alias("n_cells"))


def by_group(cells: DataFrame) -> DataFrame:
    return cells.where("d = 1 and g is not null").groupBy("g").agg(F.avg("eff").alias("att"), F.count("eff").alias("n_cells"))


def in_window(cells: DataFrame, on: str, window: tuple[int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """One count-weighted mean over the event times of a window (placebo and carryover tests), by ``keys`` if any."""
    return cells.where(F.col(on).between(*window)).groupBy(*keys).agg(F.avg("eff").alias("att"), F.count("eff").alias("n_cells"))


def balanced(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event-time and overall effects over the cells of balanced runs."""
    rows = cells.where("balanced = 1")
    return by_event_time(rows), rows.where("d = 1").agg(F.avg("eff").alias("att_avg"), F.count("eff").alias("n_cells"))


def pre_period_sd(cells: DataFrame) -> DataFrame:
    return cells.where("t_on <= 0").groupBy(F.col("t_on").alias("event_time")).agg(F.stddev_samp("eff").alias("sd"), F.count("eff").alias("n_cells"))


def cumulative(event: DataFrame, window: tuple[int, int]) -> DataFrame:
    """att_cumu up to each event time: the count-weighted mean times the number of periods so far.

    Over one row an event time: a single window partition is bounded by the number of periods."""
    order = W.partitionBy(F.lit(1)).orderBy("event_time").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = event.where(F.col("event_time").between(*window) & F.col("att").isNotNull())
    value = F.sum(F.col("att") * F.col("n_cells")).over(order) / F.sum("n_cells").over(order) * F.count(F.lit(1)).over(order)
    return rows.select("event_time", value.alias("att_cumu"), "n_cells")


def per_period_units(cells: DataFrame) -> DataFrame:
    """The cells' effects beside the number of observed units at their event time (a small table joined back)."""
    rows = cells.where("t_on is not null and eff is not null")
    return rows.join(F.broadcast(treated_units(rows)), F.col("t_on") == F.col("event_time")).select("unit", "time_ix", "event_time", "eff", "n_units")


def subgroup_cumulative(cells: DataFrame, window: tuple[int, int]) -> DataFrame:
    """cumulative effect at each event time s of the window: mean effect over event times up to s, times their number."""
    per = cells.where(F.col("rel_time").between(*window)).groupBy(F.col("rel_time").alias("event_time")).agg(F.sum("eff").alias("s"), F.count("eff").alias("n"))
    order = W.partitionBy(F.lit(1)).orderBy("event_time").rowsBetween(W.unboundedPreceding, W.currentRow)
    value = F.sum("s").over(order) / F.sum("n").over(order) * F.count(F.lit(1)).over(order)
    return per.select("event_time", value.alias("cumulative"), F.col("n").alias("n_cells"))


def proportional(cells: DataFrame) -> DataFrame:
    """aptt: mean effect over mean counterfactual of the treated cells, by event time."""
    rows = cells.where("d = 1 and t_on is not null and eff is not null")
    return rows.groupBy(F.col("t_on").alias("event_time")).agg((F.avg("eff") / F.avg(F.col("y") - F.col("eff"))).alias("aptt"), F.count("eff").alias("n_cells"))


def logarithmic(cells: DataFrame) -> DataFrame:
    """log_att by event time over the cells whose outcome and counterfactual are positive; n_dropped are the others."""
    rows = cells.where("d = 1 and t_on is not null and eff is not null")
    good = (F.col("y") > 0) & (F.col("y0") > 0)
    return rows.groupBy(F.col("t_on").alias("event_time")).agg(
        F.avg(F.when(good, F.log("y") - F.log("y0"))).alias("log_att"), F.count(F.when(good, 1)).alias("n_cells"), F.count(F.when(~good, 1)).alias("n_dropped"))


def treated_units(cells: DataFrame) -> DataFrame:
    """n_units under observation at each event time."""
    return cells.where("t_on is not null and i_obs = 1").groupBy(F.col("t_on").alias("event_time")).agg(F.count_distinct("unit").alias("n_units"))


def paths(cells: DataFrame, staggered: bool = True) -> DataFrame:
    """Average treated and counterfactual outcomes: by event time for staggered adoption, by period for a common one."""
    rows = cells.where("ever = 1")
    if staggered:
        rows = rows.where("t_on is not null and (t_on <= 0 or d = 1)").withColumn("at", F.col("t_on"))
    else:
        rows = rows.withColumn("at", F.col("time_ix"))
    y = F.when(F.col("y0").isNotNull() & (F.col("i_obs") == 1), F.col("y"))
    return rows.groupBy("at").agg(F.avg(y).alias("treated_avg"), F.avg(F.when(F.col("i_obs") == 1, F.col("y0"))).alias("counterfactual_avg"), F.count(y).alias("n_cells"))


def by_moderator(cells: DataFrame, covariate: str, bins: int | None = None) -> DataFrame:
    """Effects of treated cells by a discrete covariate, or by equal-width bins of a continuous one."""
    rows = cells.where(F.col("d") == 1).where(F.col(covariate).isNotNull())
    if bins:
        edge = rows.agg(F.min(covariate).alias("lo"), F.max(covariate).alias("hi"))
        rows = rows.join(F.broadcast(edge)).withColumn("level", F.least(F.floor((F.col(covariate) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("double"))
    else:
        rows = rows.withColumn("level", F.col(covariate).cast("double"))
    return rows.groupBy("level").agg(F.avg("eff").alias("att"), F.count("eff").alias("n_cells"))
