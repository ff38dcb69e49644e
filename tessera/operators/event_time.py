"""Event time, reversals and cohorts: window functions over a unit's periods.

All windows partition by unit, so that one shuffle on the unit serves them and the densified panel alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def with_event_time(cells: DataFrame, d: str = "d", to: str = "t_on", off: bool = False, unit: str = "unit", time: str = "time_ix") -> DataFrame:
    """Add ``to``: periods since entry (1 is the first treated period, 0 the last before).

    Leading periods with unobserved treatment have none; later gaps carry the treatment forward. A run of treated
    periods counts 1, 2, ... unless it is the unit's first run (its start is unknown); a run of untreated
    periods counts up to 0 unless it is the last (nothing follows). ``off`` measures exit instead of entry."""
    by_unit = W.partitionBy(unit).orderBy(time)
    state = F.last(F.col(d), ignorenulls=True).over(by_unit.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = cells.withColumn("__v", (1 - state) if off else state)
    changed = F.when(F.col("__v") != F.lag("__v").over(by_unit), 1).otherwise(0)
    out = out.withColumn("__change", changed).withColumn("__run", F.when(F.col("__v").isNotNull(), F.sum("__change").over(by_unit.rowsBetween(W.unboundedPreceding, W.currentRow))))
    by_run = W.partitionBy(unit, "__run")
    out = out.withColumn("__pos", F.row_number().over(by_run.orderBy(time))).withColumn("__len", F.count(F.lit(1)).over(by_run)).withColumn("__last", F.max("__run").over(W.partitionBy(unit)))
    value = F.when((F.col("__v") == 1) & (F.col("__run") > 0), F.col("__pos")).when((F.col("__v") == 0) & (F.col("__run") < F.col("__last")), F.col("__pos") - F.col("__len"))
    return out.withColumn(to, value.cast("int")).drop("__v", "__change", "__run", "__pos", "__len", "__last")


def reversal(d: str = "d", unit: str = "unit", time: str = "time_ix") -> Column:
    """True at periods that are untreated although the unit was treated before."""
    so_far = W.partitionBy(unit).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (F.max(d).over(so_far) == 1) & (F.coalesce(F.col(d), F.lit(0)) == 0)


def has_reversals(cells: DataFrame) -> bool:
    """Whether an observed cell is untreated after its unit was treated; a missing cell says nothing."""
    return cells.select((reversal() & F.col("d").isNotNull()).alias("r")).where("r").limit(1).count() > 0


def first_treated(d: str = "d", unit: str = "unit", time: str = "time_ix") -> Column:
    return F.min(F.when(F.col(d) == 1, F.col(time))).over(W.partitionBy(unit))


def with_cohorts(cells: DataFrame, entry_time: list[tuple[int, int]] | None = None, start0: bool = False, drop_always_treated: bool = False, unit: str = "unit", time: str = "time_ix", d: str = "d") -> DataFrame:
    """Add first_treat, cohort, time_to_treatment and time_to_exit.

    Cohorts are ``Cohort:<first treated period>``, or the interval of ``entry_time`` that holds it (``Cohort:Other``
    elsewhere), and ``Control``. ``start0`` lets the first treated period be 0 instead of 1."""
    out = cells
    if drop_always_treated:
        out = out.withColumn("__share", F.avg(d).over(W.partitionBy(unit))).where((F.col("__share") < 1) | F.col("__share").isNull()).drop("__share")
    out = out.withColumn("first_treat", first_treated(d, unit, time))
    label: Column
    if entry_time:
        label = F.lit("Cohort:Other")
        for low, high in reversed(entry_time):
            label = F.when(F.col("first_treat").between(low, high), F.lit(f"Cohort:{low}-{high}")).otherwise(label)
    else:
        label = F.concat(F.lit("Cohort:"), F.col("first_treat").cast("string"))
    out = out.withColumn("cohort", F.when(F.col("first_treat").isNull(), F.lit("Control")).otherwise(label))
    shift = 1 if start0 else 0
    out = with_event_time(out, d, "time_to_treatment", unit=unit, time=time)
    out = with_event_time(out, d, "time_to_exit", off=True, unit=unit, time=time)
    return out.withColumn("time_to_treatment", F.col("time_to_treatment") - shift).withColumn("time_to_exit", F.col("time_to_exit") - shift)


def with_relative_time(cells: DataFrame, to: str = "rel_time", unit: str = "unit", time: str = "time_ix", d: str = "d") -> DataFrame:
    """Periods since the last one before first treatment, for panels without reversals."""
    so_far = W.partitionBy(unit).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = cells.withColumn("__ever", F.max(F.coalesce(F.col(d), F.lit(0))).over(so_far))
    before = F.sum(1 - F.col("__ever")).over(W.partitionBy(unit))
    position = F.row_number().over(W.partitionBy(unit).orderBy(time))
    return out.withColumn(to, (position - before).cast("int")).drop("__ever")
