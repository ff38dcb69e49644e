"""From a long table to the dense panel of cells, and the masks over it.

``cells`` has a row for each unit and period: unit, time, time_ix (1..T), y, d, i_obs (outcome and covariates observed),
i_d (treatment observed), w, g, cl, x1.., and ii (usable for fitting). It is made by one shuffle on the unit: a
unit's rows are gathered into a map by period (T entries at most, keys are unique) and the map is read at
every period, so neither a cross join nor a join back is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.spec import FitOptions, PanelSpec
from . import event_time

#: Periods that a panel may have: they travel as a literal in the plan.
MAX_PERIODS = 20000


def finite(column: Column) -> Column:
    value = column.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def pruned(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The columns in their roles' names; infinite outcomes are missing; rows of weight zero are dropped."""
    rows = df.select(
        F.col(spec.unit).alias("unit"), F.col(spec.time).alias("time"), finite(F.col(spec.y)).alias("y"), F.col(spec.d).cast("int").alias("d"),
        (F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)).alias("w"),
        *([F.col(spec.agg_weight).cast("double").alias("wa")] if spec.agg_weight else []),
        (F.col(spec.group).cast("string") if spec.group else F.lit(None).cast("string")).alias("g"),
        (F.col(spec.cluster).cast("string") if spec.cluster else F.lit(None).cast("string")).alias("cl"),
        *(finite(F.col(c)).alias(f"x{i + 1}") for i, c in enumerate(spec.x)),
        *(F.col(c).cast("string").alias(f"fe{i + 1}") for i, c in enumerate(spec.extra_fe)),
        *(finite(F.col(c)).alias(f"z{i + 1}") for i, c in enumerate(spec.z)), *(finite(F.col(c)).alias(f"q{i + 1}") for i, c in enumerate(spec.q)),
        *([F.col(spec.gamma).cast("string").alias("tg")] if spec.gamma else []), *([F.col(spec.kappa).cast("string").alias("ug")] if spec.kappa else []),
    )
    rows = rows.where(F.col("unit").isNotNull() & F.col("time").isNotNull())
    return rows.where("w > 0") if spec.weight else rows


def violations(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(check_name, n_bad), one row for each rule a panel must keep; all zero for a sound one."""
    rows = pruned(df, spec)
    keys = rows.groupBy("unit", "time").count()
    duplicate = keys.agg(F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("n"))
    d = rows.agg(
        F.coalesce(F.sum((F.col("d").isNull() | ~F.col("d").isin(0, 1)).cast("long")), F.lit(0)).alias("not_binary"),
        F.when((F.min("d") == 0) & (F.max("d") == 1), 0).otherwise(1).cast("long").alias("no_variation"))
    groups = rows.groupBy("unit").agg(F.count_distinct("g").alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("n"))
    out = duplicate.select(F.lit("duplicate_key").alias("check_name"), F.col("n").alias("n_bad"))
    out = out.unionByName(d.select(F.lit("treatment_not_binary").alias("check_name"), F.col("not_binary").alias("n_bad")))
    out = out.unionByName(d.select(F.lit("treatment_constant").alias("check_name"), F.col("no_variation").alias("n_bad")))
    out = out.unionByName(groups.select(F.lit("group_changes_in_unit").alias("check_name"), F.col("n").alias("n_bad")))
    for i in range(len(spec.x)):
        for key in ("unit", "time"):
            var = rows.groupBy(key).agg(F.var_samp(f"x{i + 1}").alias("v")).agg(F.when(F.coalesce(F.sum("v"), F.lit(0.0)) <= 0, 1).otherwise(0).cast("long").alias("n_bad"))
            out = out.unionByName(var.select(F.lit(f"x{i + 1}_constant_within_{key}").alias("check_name"), "n_bad"))
    return out


def check(df: DataFrame, spec: PanelSpec) -> None:
    """Raise on the first rule that the panel breaks."""
    bad = [r["check_name"] for r in violations(df, spec).where("n_bad > 0").collect()]
    bad = [b for b in bad if not b.startswith("x")] + [b for b in bad if b.startswith("x")]
    if bad:
        raise ValueError("not a sound panel: " + ", ".join(sorted(bad)))


def periods(rows: DataFrame) -> list:
    """The sorted periods. Their number is checked: they become a literal of the plan."""
    got = [r[0] for r in rows.select("time").distinct().limit(MAX_PERIODS + 1).collect()]
    if len(got) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    return sorted(got)


def densify(df: DataFrame, spec: PanelSpec, na_rm: bool = False) -> DataFrame:
    """The complete grid of units and periods. With ``na_rm`` a row that lacks anything is dropped; otherwise
    its treatment is kept, so that event time doesn't break at gaps of the outcome."""
    rows = pruned(df, spec)
    if na_rm:
        rows = rows.dropna(subset=["y", "d", *(f"x{i + 1}" for i in range(len(spec.x)))])
    times = periods(rows)
    if not times:
        raise ValueError("the panel has no rows")
    carried = [c for c in rows.columns if c not in ("unit", "time")]
    literal = F.array(*(F.lit(t) for t in times))
    indexed = rows.withColumn("time_ix", F.array_position(literal, F.col("time")).cast("int"))
    per_unit = indexed.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("time_ix", F.struct(*carried)))).alias("m"))
    cells = per_unit.select("unit", "m", F.explode(F.sequence(F.lit(1), F.lit(len(times)))).alias("time_ix"))
    cells = cells.select("unit", F.element_at(literal, F.col("time_ix")).alias("time"), "time_ix", F.try_element_at("m", F.col("time_ix")).alias("c"))
    cells = cells.select("unit", "time", "time_ix", *(F.col("c").getField(c).alias(c) for c in carried))
    observed = F.col("y").isNotNull()
    for i in range(len(spec.x)):
        observed = observed & F.col(f"x{i + 1}").isNotNull()
    cells = cells.withColumn("i_obs", observed.cast("int")).withColumn("i_d", F.col("d").isNotNull().cast("int"))
    for c in ("g", "cl"):
        cells = cells.withColumn(c, F.max(c).over(W.partitionBy("unit")))
    if spec.agg_weight:
        cells = cells.withColumn("wa", F.coalesce("wa", F.lit(0.0)))
    return cells.withColumn("w", F.coalesce("w", F.lit(1.0)))


def with_carry(cells: DataFrame, k: int) -> DataFrame:
    """Add is_carry: among the first k periods after a treated one, itself not treated."""
    if not k:
        return cells.withColumn("is_carry", F.lit(0))
    recent = F.coalesce(F.max(F.coalesce(F.col("d"), F.lit(0))).over(W.partitionBy("unit").orderBy("time_ix").rangeBetween(-k, -1)), F.lit(0))
    return cells.withColumn("is_carry", ((recent == 1) & (F.coalesce(F.col("d"), F.lit(0)) == 0)).cast("int"))


def with_usable(cells: DataFrame, options: FitOptions) -> DataFrame:
    """Add ever (unit ever treated) and ii: observed, not treated, not carried over. Estimators on never-treated units use
    treated units' earlier cells too, for their unit effects; ``never_treated_sample`` is for those that don't."""
    untreated = (F.col("i_obs") == 1) & (F.coalesce(F.col("d"), F.lit(0)) == 0) & (F.col("is_carry") == 0)
    out = cells.withColumn("ever", F.max(F.coalesce(F.col("d"), F.lit(0))).over(W.partitionBy("unit")))
    return out.withColumn("ii", untreated.cast("int"))


def never_treated_sample(cells: DataFrame) -> DataFrame:
    """Take every cell of ever-treated units out of the fit, for estimators that don't split the sample themselves."""
    return cells.withColumn("ii", F.when(F.col("ever") == 1, 0).otherwise(F.col("ii")))


def occupancy(cells: DataFrame) -> DataFrame:
    """(check_name, n_bad): periods and units without a usable cell."""
    def empty(key: str) -> DataFrame:
        counts = cells.groupBy(key).agg(F.sum("ii").alias("n"))
        return counts.agg(F.coalesce(F.sum((F.col("n") == 0).cast("long")), F.lit(0)).alias("n_bad")).select(F.lit(f"empty_{key}").alias("check_name"), "n_bad")

    return empty("time_ix").unionByName(empty("unit"))


def check_occupancy(cells: DataFrame, options: FitOptions) -> None:
    """Raise where a period, or under the not-yet-treated sample a unit, has no usable cell to fit on."""
    wanted = ["empty_time_ix"] + (["empty_unit"] if options.sample == "notyettreated" else [])
    bad = [r["check_name"] for r in occupancy(cells).where("n_bad > 0").collect() if r["check_name"] in wanted]
    if bad:
        hint = "; a smaller test window may help" if options.placebo or options.carryover else ""
        raise ValueError(f"nothing to fit on: {', '.join(sorted(bad))}{hint}")


def with_window_mask(cells: DataFrame, column: str, window: tuple[int, int], to: str) -> DataFrame:
    """Take the cells whose event time lies in the window out of the fit; ``to`` marks them."""
    hit = F.coalesce(F.col(column).between(*window), F.lit(False))
    return cells.withColumn(to, hit.cast("int")).withColumn("ii", F.when(hit, 0).otherwise(F.col("ii")))


def screened(cells: DataFrame, options: FitOptions) -> DataFrame:
    """Drop units with too few usable or too many unobserved cells, then periods without a usable one."""
    by_unit = W.partitionBy("unit")
    out = cells.withColumn("__usable", F.sum("ii").over(by_unit)).withColumn("__missing", F.sum(1 - F.col("i_obs")).over(by_unit))
    keep = F.col("__usable") >= options.effective_min_t0
    if options.sample == "nevertreated":
        keep = keep | (F.col("ever") == 0)
    if options.max_missing is not None:
        keep = keep & (F.col("__missing") <= options.max_missing)
    out = out.where(keep).drop("__usable", "__missing")
    usable = F.col("ii") if options.sample == "notyettreated" else F.col("ii") * (1 - F.col("ever"))
    counts = out.groupBy("time_ix").agg(F.sum(usable).alias("__n")).where("__n > 0").select("time_ix")
    return out.join(counts, "time_ix", "left_semi")


def with_balance(cells: DataFrame, window: tuple[int, int], fill_missing: bool = False) -> DataFrame:
    """Add balanced: the cell belongs to a complete run of event times window[0]..window[1] around one entry."""
    low, high = window
    spell = F.sum(F.when(F.col("t_on") == 1, 1).otherwise(0)).over(W.partitionBy("unit").orderBy(F.col("time_ix").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    # cells at event times up to 0 belong to the next entry, later ones to the last
    following = F.when(F.col("t_on") <= 0, F.col("__spell")).when(F.col("t_on") == 1, F.col("__spell")).otherwise(F.col("__spell") + 1)
    out = cells.withColumn("__spell", spell).withColumn("__entry", following)
    inside = F.col("t_on").between(low, high)
    counts = inside if fill_missing else inside & (F.col("i_obs") == 1)
    n = F.sum(counts.cast("int")).over(W.partitionBy("unit", "__entry"))
    return out.withColumn("balanced", F.coalesce((inside & (n == high - low + 1)).cast("int"), F.lit(0))).drop("__spell", "__entry")


def status(cells: DataFrame) -> DataFrame:
    """Add obs_status: 1 treated, 2 control, 3 missing, 5 under a placebo or carryover test, 6 carryover removed,
    7 and 8 in a balanced run before and after entry."""
    d = F.coalesce(F.col("d"), F.lit(0))
    code = F.when(F.col("i_obs") == 0, 3)
    names = cells.columns
    for mark in ("is_placebo", "is_carry_test"):
        if mark in names:
            code = code.when(F.col(mark) == 1, 5)
    if "is_carry" in names:
        code = code.when(F.col("is_carry") == 1, 6)
    if "balanced" in names:
        code = code.when((F.col("balanced") == 1) & (F.col("t_on") <= 0), 7).when(F.col("balanced") == 1, 8)
    return cells.withColumn("obs_status", code.when(d == 1, 1).otherwise(2))


def prepare(df: DataFrame, spec: PanelSpec, options: FitOptions | None = None, na_rm: bool = False) -> DataFrame:
    """Densified cells with event times, masks and screens, in one plan partitioned by unit."""
    options = (options or FitOptions()).resolved()
    cells = with_carry(densify(df, spec, na_rm), options.carryover_rm)
    if not options.keep_always_treated:
        cells = cells.withColumn("__share", F.avg("d").over(W.partitionBy("unit"))).where("__share < 1 or __share is null").drop("__share")
    cells = with_usable(cells, options)
    cells = event_time.with_event_time(cells, "d", "t_on")
    cells = event_time.with_event_time(cells, "d", "t_off", off=True)
    if options.carryover_rm:
        cells = event_time.with_event_time(cells, "is_carry", "t_on_carry")
    if options.placebo:
        cells = with_window_mask(cells, "t_on", options.placebo, "is_placebo")
    if options.carryover:
        cells = with_window_mask(cells, "t_off", options.carryover, "is_carry_test")
    if options.balance:
        cells = with_balance(cells, options.balance, options.fill_missing)
    return screened(cells, options)


def valid_controls(cells: DataFrame, r: int, unit_effects: bool = True) -> DataFrame:
    """Never-treated units with enough observations before the first adoption and one after the last."""
    onset = cells.where("d = 1").groupBy("unit").agg(F.min("time_ix").alias("t")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    rows = cells.where("ever = 0").join(F.broadcast(onset))
    n = rows.groupBy("unit").agg(F.sum(((F.col("time_ix") < F.col("first")) & (F.col("i_obs") == 1)).cast("int")).alias("before"), F.sum(((F.col("time_ix") > F.col("last")) & (F.col("i_obs") == 1)).cast("int")).alias("after"))
    return n.where((F.col("before") >= r + int(unit_effects)) & (F.col("after") >= 1)).select("unit")
