"""Difference-in-differences comparators: two-way fixed effects, stacked, interaction-weighted, and group-time
estimators with never- or not-yet-treated controls.

Cells may be missing: the regressions solve their normal equations exactly, and group-time effects average the changes
of the units that are observed in both periods, or compare means of all observed cells. No pair of units is ever formed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from . import additive


def _absorbing(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Observed cells of units that aren't treated from the start: unit, time_ix, y, d (absorbing), first, and ``keep``."""
    first = F.min(F.when(F.col("d") == 1, F.col("time_ix"))).over(W.partitionBy("unit"))
    start = F.min("time_ix").over(W.partitionBy("unit"))
    rows = cells.where("i_obs = 1").withColumn("first", first).withColumn("__start", start)
    rows = rows.where(F.col("first").isNull() | (F.col("first") > F.col("__start")))
    return rows.select("unit", "time_ix", "y", "first", F.coalesce((F.col("time_ix") >= F.col("first")).cast("int"), F.lit(0)).alias("d"), *keep)


#: Cohorts whose base periods a row may be compared with: that many outcomes travel with a unit.
MAX_COHORTS = 500


def _coefficient(table: pa.Table) -> pa.Table:
    """Of one key's normal equations with treatment last: what is left of treatment and outcome after the periods."""
    order = np.argsort(table.column("i").to_numpy())
    a = np.stack(table.column("v").to_pylist())[order]
    gram, b = a[:, :-1], a[:, -1]
    partial = np.linalg.pinv(gram[:-1, :-1], rcond=1e-10, hermitian=True) @ np.column_stack([gram[:-1, -1], b[:-1]])
    return pa.table({"num": [float(b[-1] - gram[-1, :-1] @ partial[:, 1])], "den": [float(gram[-1, -1] - gram[-1, :-1] @ partial[:, 0])]})


def _regressed(rows: DataFrame, key: str | None = None) -> DataFrame:
    """att and n_cells of the regression of y on treatment, unit and period effects; with ``key`` both kinds of effects
    are each key's own."""
    n_periods = rows.agg(F.max("time_ix")).first()[0] or 1
    sums = additive.normal_equations(rows, n_periods, ("d",), key=key)
    solved = sums.groupBy("k").applyInArrow(_coefficient, "num double, den double")
    att = solved.agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0.0))).alias("att"))
    return att.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_cells"))))  # one row each


def twfe(cells: DataFrame) -> DataFrame:
    """att: coefficient of treatment in the two-way regression."""
    return _regressed(_absorbing(cells))


def twfe_clustered(cells: DataFrame, x: tuple[str, ...] = (), cluster: str = "unit", level: float = 0.95) -> DataFrame:
    """att, se, ci_low, ci_high, n_cells and n_clusters of treatment's coefficient beside covariates, with errors that may depend on each other
    within a cluster.

    Treatment and outcome are freed from effects and covariates by two exact fits; a cluster's score is one sum over its cells, so the
    sandwich is an aggregation by cluster. Finite samples: (n - 1) / (n - k) * g / (g - 1), where unit effects, which lie within clusters,
    don't count in k = 1 + covariates + periods."""
    rows = _absorbing(cells, (*x, *({cluster} - {"unit"}))).where(" and ".join(f"{c} is not null" for c in ("y", *x)))
    rows = rows.withColumns({"ii": F.lit(1), "ever": F.col("d")})
    n_periods = rows.select("time_ix").distinct().count()
    treatment, _ = additive.exact_fit(rows.withColumn("__y", F.col("y")).withColumn("y", F.col("d").cast("double")), x)
    treatment = treatment.select("unit", "time_ix", *({cluster} - {"unit"}), "d", *x, (F.col("y") - F.col("y0")).alias("__d"), F.col("__y").alias("y"), "ii", "ever")
    whole, info = additive.exact_fit(treatment, ("d", *x))
    per = whole.groupBy(cluster).agg(F.sum(F.col("__d") * (F.col("y") - F.col("y0"))).alias("score"), F.sum(F.col("__d") ** 2).alias("size"), F.count(F.lit(1)).alias("n"))
    z, k = stats.norm_ppf(0.5 + level / 2), 1 + len(x) + n_periods
    out = per.agg(F.sum(F.col("score") ** 2).alias("meat"), F.sum("size").alias("bread"), F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_clusters"))
    small = (F.col("n_cells") - 1) / (F.col("n_cells") - k) * F.col("n_clusters") / (F.col("n_clusters") - 1)
    att, se = F.lit(float(info["beta"][0])), F.sqrt(F.col("meat") * small) / F.col("bread")
    return out.select(att.alias("att"), se.alias("se"), (att - z * se).alias("ci_low"), (att + z * se).alias("ci_high"), "n_cells", "n_clusters")


def cohorts(rows: DataFrame) -> list[int]:
    """The first treated periods that occur, in order; their number is checked."""
    got = [r[0] for r in rows.select("first").where("first is not null").distinct().limit(MAX_COHORTS + 1).collect()]
    if len(got) > MAX_COHORTS:
        raise ValueError(f"more than {MAX_COHORTS} cohorts")
    return sorted(got)


def stacked(cells: DataFrame) -> DataFrame:
    """att over the stacks of every cohort with the never-treated units, effects by stack-unit and stack-period."""
    rows = _absorbing(cells)
    stacks = F.when(F.col("first").isNotNull(), F.array("first")).otherwise(F.array(*(F.lit(c) for c in cohorts(rows))).cast("array<int>"))
    return _regressed(rows.select("unit", "time_ix", "y", "d", F.explode(stacks).alias("stack")), "stack")


def twfe_event_study(cells: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """(event_time, coef): the two-way regression on indicators of event time, the last period before treatment left out.
    Event times beyond the window belong to its ends. One matrix of checked size reaches the driver."""
    rows = _absorbing(cells)
    at = F.col("time_ix") - F.col("first") + 1
    if window:
        at = F.greatest(F.least(at, F.lit(window[1])), F.lit(window[0]))
    rows = rows.withColumn("at", at)
    n_periods = rows.agg(F.max("time_ix")).first()[0] or 1
    times = sorted(r[0] for r in rows.select("at").where("at is not null and at <> 0").distinct().collect())  # fewer than twice the periods
    x = tuple(f"e{i}" for i in range(len(times)))
    rows = rows.select("unit", "time_ix", "y", *(F.coalesce((F.col("at") == e).cast("double"), F.lit(0.0)).alias(c) for e, c in zip(times, x, strict=True)))
    sums = additive.normal_equations(rows, n_periods, x).toArrow()
    a = np.zeros((n_periods + len(x), n_periods + len(x) + 1))
    if sums.num_rows:
        a[sums.column("i").to_numpy()] = np.stack(sums.column("v").to_pylist())
    solved = np.linalg.pinv(a[:, :-1], rcond=1e-10, hermitian=True) @ a[:, -1]
    return cells.sparkSession.createDataFrame([(int(e), float(v)) for e, v in zip(times, solved[n_periods:], strict=True)], "event_time int, coef double")


def group_time(cells: DataFrame, control: str = "never", base: str = "varying") -> DataFrame:
    """(cohort, time_ix, event_time, att, n_units): group-time effects by two-by-two comparisons of changes.

    The base period is the last before treatment; ``varying`` compares earlier periods with the one before them.
    Controls are never-treated units or, with ``notyet``, all units untreated at both periods; a unit counts where it is
    observed in both periods. A row meets its unit's outcomes in the cohorts' base periods (their number is checked), and
    only sums by cohort and period leave the tasks."""
    rows = _absorbing(cells)
    bases = [c - 1 for c in cohorts(rows)]
    by_unit = W.partitionBy("unit")
    t, first = F.col("time_ix"), F.col("first")
    at_base = F.collect_list(F.when(t.isin(bases), F.struct(t.alias("ref"), F.col("y").alias("y_ref")))).over(by_unit)
    previous = F.when(F.lag("time_ix").over(by_unit.orderBy("time_ix")) == t - 1, F.lag("y").over(by_unit.orderBy("time_ix")))
    rows = rows.withColumn("at_base", at_base).withColumn("y_before", previous)
    # against the cohort's base period
    pairs = rows.select("time_ix", "first", "y", F.explode("at_base").alias("b"))
    cohort = (F.col("b.ref") + 1).cast("int")
    if base == "varying":
        pairs = pairs.where(t >= cohort)
    change = F.col("y") - F.col("b.y_ref")
    own = F.coalesce(first == cohort, F.lit(False))
    outside = first.isNull() if control == "never" else first.isNull() | ((first > F.greatest(t, F.col("b.ref"))) & ~own)
    late = pairs.groupBy(cohort.alias("cohort"), "time_ix").agg(
        F.avg(F.when(own, change)).alias("moved"), F.count(F.when(own, change)).alias("n_units"), F.avg(F.when(outside, change)).alias("stayed"))
    if base == "varying":
        # earlier periods against the one before: sums by cohort (0 for never treated), then what all later cohorts add up to
        steps = rows.where("y_before is not null").groupBy(F.coalesce("first", F.lit(0)).alias("cohort"), "time_ix").agg(F.sum(F.col("y") - F.col("y_before")).alias("s"), F.count(F.lit(1)).alias("n"))
        outside = F.col("cohort") == 0 if control == "never" else (F.col("cohort") == 0) | (F.col("cohort") > t)
        every = steps.groupBy("time_ix").agg(F.sum(F.when(outside, F.col("s"))).alias("s_all"), F.sum(F.when(outside, F.col("n"))).alias("n_all"))
        early = steps.where("cohort > time_ix").join(every, "time_ix")
        mine = F.lit(0) if control == "never" else F.lit(1)
        left = F.col("n_all") - mine * F.col("n")
        early = early.select("cohort", "time_ix", (F.col("s") / F.col("n")).alias("moved"), F.col("n").alias("n_units"), F.when(left > 0, (F.col("s_all") - mine * F.col("s")) / left).alias("stayed"))
        late = late.unionByName(early)
    out = late.where("moved is not null and stayed is not null")
    return out.select("cohort", "time_ix", (t - F.col("cohort") + 1).cast("int").alias("event_time"), (F.col("moved") - F.col("stayed")).alias("att"), "n_units")


def group_time_of_means(cells: DataFrame, control: str = "never", base: str = "varying") -> DataFrame:
    """``group_time`` from the means of cells instead of units' changes: a unit counts in each of both periods in which it is
    observed, as in repeated cross-sections. The same where no cell is missing. att is null where no control is observed in one of the
    periods; n_units counts the cohort's cells of the period itself.

    Sums by cohort and period leave the tasks; a period's sums, one for each cohort (their number is checked), meet the effects of that period."""
    rows = _absorbing(cells)
    cohorts(rows)
    sums = rows.groupBy("time_ix", "first").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    own = sums.where("first is not null").select(F.col("first").alias("cohort"), "time_ix", (F.col("s") / F.col("n")).alias("y"), F.col("n").alias("n_units"))
    t, cohort = F.col("time_ix"), F.col("cohort")
    ref = (F.when(t >= cohort, cohort - 1).otherwise(t - 1) if base == "varying" else cohort - 1).cast("int")
    past = own.select("cohort", F.col("time_ix").alias("ref"), F.col("y").alias("y_ref"))
    out = own.withColumn("ref", ref).join(past, ["cohort", "ref"])
    every = sums.groupBy("time_ix").agg(F.collect_list(F.struct("first", "s", "n")).alias("every"))
    out = out.join(every.withColumnRenamed("every", "now"), "time_ix").join(every.withColumnsRenamed({"time_ix": "ref", "every": "then"}), "ref")

    def outside(c: Column) -> Column:
        never = c["first"].isNull()
        return never if control == "never" else never | ((c["first"] > F.greatest("time_ix", "ref")) & (c["first"] != cohort))

    def mean(name: str) -> Column:
        total = lambda field, zero: F.aggregate(F.filter(name, outside), F.lit(zero).cast("double" if field == "s" else "long"), lambda a, c: a + c[field])
        return total("s", 0.0) / F.nullif(total("n", 0).cast("double"), F.lit(0.0))

    met = F.exists("now", outside) | F.exists("then", outside)
    att = (F.col("y") - F.col("y_ref")) - (mean("now") - mean("then"))
    return out.where(met).select("cohort", "time_ix", (t - cohort + 1).cast("int").alias("event_time"), att.alias("att"), "n_units")


def aggregated(effects: DataFrame, how: str = "dynamic") -> DataFrame:
    """Group-time effects averaged by cohort size: by event time, or over all post-treatment cells (``simple``)."""
    weighted = (F.sum(F.col("att") * F.col("n_units")) / F.sum("n_units")).alias("att")
    if how == "dynamic":
        return effects.groupBy("event_time").agg(weighted, F.sum("n_units").alias("n_units"))
    return effects.where("event_time >= 1").agg(weighted, F.sum("n_units").alias("n_units"))


def interaction_weighted(cells: DataFrame, means: bool = False) -> DataFrame:
    """att by event time: cohort-by-period effects with never-treated controls and the last period before treatment as base
    (on a balanced panel the saturated regression's), weighted by cohort shares. ``means`` compares means of cells, as ``group_time_of_means``."""
    if means:
        return aggregated(group_time_of_means(cells, "never", base="universal").where("att is not null"), "dynamic")
    return aggregated(group_time(cells, "never", base="universal"), "dynamic")


def switchers(cells: DataFrame) -> DataFrame:
    """did_m: at each period the change of units that switch treatment against that of units that don't and had the
    same treatment before; joiners and leavers averaged by their number. Needs no absorbing treatment."""
    by_unit = W.partitionBy("unit").orderBy("time_ix")
    rows = cells.where("i_obs = 1").select("unit", "time_ix", "d", "y", F.lag("d").over(by_unit).alias("d0"), F.lag("y").over(by_unit).alias("y0"), F.lag("time_ix").over(by_unit).alias("t0"))
    rows = rows.where("t0 = time_ix - 1").withColumn("dy", F.col("y") - F.col("y0"))
    per = rows.groupBy("time_ix", "d0").agg(F.avg(F.when(F.col("d") != F.col("d0"), F.col("dy"))).alias("moved"), F.avg(F.when(F.col("d") == F.col("d0"), F.col("dy"))).alias("stayed"), F.count(F.when(F.col("d") != F.col("d0"), 1)).alias("n"))
    per = per.where("moved is not null and stayed is not null")
    sign = F.when(F.col("d0") == 0, 1).otherwise(-1)
    return per.agg((F.sum(sign * (F.col("moved") - F.col("stayed")) * F.col("n")) / F.sum("n")).alias("did_m"), F.sum("n").alias("n_switchers"))


def switcher_effects(cells: DataFrame, effects: int = 1, placebos: int = 0) -> DataFrame:
    """(horizon, effect, n_switchers): what switching did ``horizon`` periods on, 1 being the period of the switch; placebos have horizons below 0.

    A unit switches at F, the first period whose treatment differs from that of its first observed period. Effect l compares y at F - 1 + l with y
    at F - 1, less the same change of units with the same first treatment that haven't switched by then. Placebo l compares y at F - 1 - l
    with y at F - 1, for the switchers and controls of effect l. Leavers count with a minus. Each row meets its own earlier and later
    outcomes by windows over its unit, and only sums by horizon, period and first treatment leave the tasks."""
    by_unit = W.partitionBy("unit").orderBy("time_ix")
    every = by_unit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    start = F.first("d", ignorenulls=True).over(every)
    rows = cells.select("unit", "time_ix", "y", "d", start.alias("d1"))
    rows = rows.withColumn("switch", F.min(F.when(F.col("d") != F.col("d1"), F.col("time_ix"))).over(W.partitionBy("unit")))
    y, t, f = F.col("y"), F.col("time_ix"), F.coalesce(F.col("switch"), F.lit(1 << 30))
    reach = max(effects, placebos)
    rows = rows.withColumns({f"__b{k}": F.lag("y", k).over(by_unit) for k in range(1, reach + 1)} | {f"__l{k}": F.lead("y", k).over(by_unit) for k in range(1, placebos + 1)})
    parts = []
    for k in range(1, effects + 1):
        change = y - F.col(f"__b{k}")
        parts.append(F.struct(F.lit(k).alias("horizon"), change.alias("change"), (t == f - 1 + k).alias("moved"), (f > t).alias("stayed")))
    for k in range(1, placebos + 1):
        change, later = F.col(f"__b{k}") - y, F.col(f"__l{k}").isNotNull()
        parts.append(F.struct(F.lit(-k).alias("horizon"), change.alias("change"), ((t == f - 1) & later).alias("moved"), (f > t + k).alias("stayed")))
    long = rows.select("time_ix", "d1", F.explode(F.array(*parts)).alias("p")).select("time_ix", "d1", "p.*").where("change is not null")
    mean = lambda on: F.avg(F.when(F.col(on), F.col("change")))
    per = long.groupBy("horizon", "time_ix", "d1").agg(mean("moved").alias("moved"), mean("stayed").alias("stayed"), F.count(F.when(F.col("moved"), 1)).alias("n"))
    per = per.where("moved is not null and stayed is not null")
    sign = F.when(F.col("d1") == 0, 1).otherwise(-1)
    return per.groupBy("horizon").agg((F.sum(sign * (F.col("moved") - F.col("stayed")) * F.col("n")) / F.sum("n")).alias("effect"), F.sum("n").alias("n_switchers"))
