"""Jackknife of the never-treated closed form without refitting.

Leaving a treated unit out takes its cells away from each mean. Leaving a control out moves the mean of a period in which it is observed by
delta_t = (m_t - y_t) / (n_t - 1), and every effect is linear in them: an effect at period t moves by -delta_t plus the mean of
delta over its unit's periods before treatment. So each estimate has one coefficient a period, and a control's replicate is the
estimate plus the sum of coefficient times delta over its cells: two aggregations and a join on the period.

A control that is alone in a period takes the period's level with it, which is not linear: such controls (one a period at most) are left out by
fits of their own."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from ..sources.stored import stored

KINDS = (("overall", None, "d = 1"), ("event", "t_on", "t_on is not null"), ("exit", "t_off", "t_off is not null"), ("calendar", "time_ix", "d = 1"))
#: Units (or cells) of a block that a task compares with another, and those that it compares at once.
BLOCK, AT_ONCE = 2048, 128


def _targets(cells: DataFrame) -> DataFrame:
    """(unit, time_ix, kind, at, eff, y): each effect once for every estimate that it enters."""
    entries = [F.when(F.expr(on), F.struct(F.lit(kind).alias("kind"), (F.col(at).cast("double") if at else F.lit(0.0)).alias("at"))) for kind, at, on in KINDS]
    rows = cells.where("eff is not null").select("unit", "time_ix", "eff", "y", F.explode(F.array(*entries)).alias("e"))
    return rows.where("e is not null").select("unit", "time_ix", "eff", "y", "e.kind", "e.at")


def _before(cells: DataFrame) -> DataFrame:
    """``cells`` with own: whether the cell enters its unit's level."""
    first = F.min(F.when(F.col("d") == 1, F.col("time_ix"))).over(W.partitionBy("unit"))
    own = (F.col("i_obs") == 1) & (F.col("ii") == 1) & (F.col("first").isNull() | (F.col("time_ix") < F.col("first")))
    return cells.withColumn("first", first).withColumn("own", own).drop("first")


def _shares(cells: DataFrame) -> DataFrame:
    """(unit, time_ix, share): the weights of a unit's level. A period without any control has none."""
    return cells.where("own and eff is not null").select("unit", "time_ix", (1 / F.count(F.lit(1)).over(W.partitionBy("unit"))).alias("share"))


def _deltas(cells: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(unit, time_ix, delta) of the controls' cells, and (left_out) the controls that are alone in a period, if there are any."""
    controls = cells.where("ever = 0 and i_obs = 1").select("unit", "time_ix", "y")
    means = controls.groupBy("time_ix").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("k"))
    met = controls.join(F.broadcast(means), "time_ix")
    alone = met.where("k = 1").select(F.col("unit").alias("left_out")).distinct()
    return met.where("k > 1").select("unit", "time_ix", ((F.col("m") - F.col("y")) / (F.col("k") - 1)).alias("delta")), alone if alone.limit(1).count() else None


def _refitted(cells: DataFrame, alone: DataFrame) -> DataFrame:
    """(left_out, unit, time_ix, eff): the effects of the fit without each unit of ``alone``; a period without controls has none."""
    met = cells.select("unit", "time_ix", "y", "i_obs", "ever", "own").join(F.broadcast(alone)).where("unit <> left_out")  # one control a period at most
    level = met.where("ever = 0 and i_obs = 1").groupBy("left_out", "time_ix").agg(F.avg("y").alias("m"))
    rest = met.where("ever = 1").join(F.broadcast(level), ["left_out", "time_ix"]).withColumn("rest", F.col("y") - F.col("m"))
    own = F.avg(F.when(F.col("own"), F.col("rest"))).over(W.partitionBy("left_out", "unit"))
    return rest.select("left_out", "unit", "time_ix", F.when(F.col("i_obs") == 1, F.col("rest") - own).alias("eff")).where("eff is not null")


def sums(cells: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(job_id, left_out, kind, at, s, sy, n): sums of eff and of y over the cells of every estimate, and their number, without each unit.

    ``cells`` have y0 and eff of ``additive.never_treated``; ``targets`` (unit, time_ix, kind, at, eff, y) are cells of treated units, the fit's usual
    estimates if not given. An estimate without cells is missing."""
    # several aggregations read these few columns
    cells = stored(_before(cells).select("unit", "time_ix", "y", "d", "i_obs", "ever", "eff", "t_on", "t_off", "own"), "unit")
    targets = _targets(cells) if targets is None else targets
    added = [F.sum("eff").alias("s"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n")]
    total = targets.groupBy("kind", "at").agg(*added)
    # treated units, and controls where they have effects of their own
    mine = targets.groupBy("unit", "kind", "at").agg(*added).withColumnsRenamed({"s": "s_own", "sy": "sy_own", "n": "n_own"})
    units = cells.groupBy("unit").agg(F.max("ever").alias("ever"))
    every = units.join(F.broadcast(total))  # estimates: a few for each period, whose number is checked
    # what a period's mean moves each estimate by
    here = targets.groupBy("kind", "at", "time_ix").agg((-F.count(F.lit(1))).cast("double").alias("c"))
    before = mine.join(_shares(cells), "unit").groupBy("kind", "at", "time_ix").agg(F.sum(F.col("n_own") * F.col("share")).alias("c"))
    moves = here.unionByName(before).groupBy("kind", "at", "time_ix").agg(F.sum("c").alias("c"))
    deltas, alone = _deltas(cells)
    moved = deltas.join(F.broadcast(moves), "time_ix").groupBy("unit", "kind", "at").agg(F.sum(F.col("c") * F.col("delta")).alias("moved"))
    out = reduce(lambda a, b: a.join(b, ["unit", "kind", "at"], "left"), (mine, moved), every)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = F.col("s") - zero("s_own") + zero("moved") * F.when(F.col("ever") == 0, 1).otherwise(0)
    out = out.select(F.col("unit").alias("left_out"), "kind", "at", s.alias("s"), (F.col("sy") - zero("sy_own")).alias("sy"), (F.col("n") - F.coalesce("n_own", F.lit(0))).alias("n"))
    if alone is not None:
        again = _refitted(cells, alone).join(targets.drop("eff"), ["unit", "time_ix"]).groupBy("left_out", "kind", "at").agg(*added)
        out = out.join(F.broadcast(alone), "left_out", "left_anti").unionByName(again)
    return out.where("n > 0").withColumn("job_id", F.xxhash64("left_out"))


def replicates(cells: DataFrame) -> DataFrame:
    """(job_id, left_out, kind, at, value, n_cells, error) for every unit left out of ``cells``, which have y0 and eff of
    ``additive.never_treated``. An estimate without cells is missing from the replicate, as a refit would leave it out."""
    return sums(cells).select("job_id", "left_out", "kind", "at", (F.col("s") / F.col("n")).alias("value"), F.col("n").alias("n_cells"), F.lit(None).cast("string").alias("error"))


def _flat(table: pa.Table, name: str, *fields: str) -> tuple[np.ndarray, ...]:
    """The rows that the entries of a list column belong to, and these fields of the entries."""
    lists = table.column(name).combine_chunks()
    of = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    inner = lists.flatten()
    return of, *(inner.field(inner.type.get_field_index(f)).to_numpy(zero_copy_only=False) for f in fields)


def _log_sums(n_periods: int, unit: str):
    def run(key: tuple, units: pa.Table, controls: pa.Table) -> pa.Table:
        """(left_out, at, s, n): sums of log y - log y0 over a block of treated units, without each control of another."""
        names = ("left_out", "at", "s", "n")
        if not units.num_rows or not controls.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (controls.column("unit").type, pa.float64(), pa.float64(), pa.int64()), strict=True)})

        of, t, share = _flat(units, "shares", "t", "share")
        weight = np.zeros((units.num_rows, n_periods))
        weight[of, t] = share
        row, t, at, y, y0 = _flat(units, "cells", "t", "at", "y", "y0")
        of, when, value = _flat(controls, "deltas", "t", "delta")
        delta = np.zeros((controls.num_rows, n_periods))
        delta[of, when] = value
        out = []
        chosen = [(a, np.flatnonzero((at == a) & (y > 0))) for a in np.unique(at)]
        for low in range(0, len(delta), AT_ONCE):
            d = delta[low : low + AT_ONCE]
            shift = d @ weight.T
            for a, on in chosen:
                level = y0[on] + d[:, t[on]] - shift[:, row[on]]
                good = level > 0
                s = np.where(good, np.log(y[on]) - np.log(np.where(good, level, 1.0)), 0.0).sum(axis=1)
                out.append((np.arange(low, low + len(d)), np.full(len(d), a), s, good.sum(axis=1)))
        who, at, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"left_out": controls.column("unit").combine_chunks().take(pa.array(who)), "at": at, "s": s, "n": n.astype(np.int64)})

    return run, f"left_out {unit}, at double, s double, n long"


def log_sums(cells: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(job_id, at, s, n): sums of log y - log y0 over ``rows`` (unit, time_ix, at, y, y0) without each unit; cells with an outcome or a counterfactual
    that has no logarithm in the replicate are left out.

    Logarithms aren't linear in a control's deltas, so every cell meets every control: blocks of treated units meet blocks of controls, each pair of
    blocks a group of its own that sends a sum for each control."""
    unit = cells.schema["unit"].dataType.simpleString()
    # cells of treated units have effects; a control's counterfactual isn't needed
    cells = stored(_before(cells).select("unit", "time_ix", "y", "d", "i_obs", "ever", "eff", "own"), "unit")
    deltas, alone = _deltas(cells)
    n_periods = int(cells.agg(F.max("time_ix")).first()[0])
    t = (F.col("time_ix") - 1).alias("t")
    units = rows.groupBy("unit").agg(F.collect_list(F.struct(t, "at", "y", "y0")).alias("cells"))
    units = units.join(_shares(cells).groupBy("unit").agg(F.collect_list(F.struct(t, "share")).alias("shares")), "unit")
    controls = deltas.groupBy("unit").agg(F.collect_list(F.struct(t, "delta")).alias("deltas"))
    n_units, n_controls = (cells.where(f"ever = {e}").select("unit").distinct().count() for e in (1, 0))
    ni, nj = max(1, -(-n_units // block)), max(1, -(-n_controls // block))
    own = lambda n: F.pmod(F.xxhash64("unit"), F.lit(n))
    dealt = units.withColumn("bi", own(ni)).withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nj - 1).cast("long"))))
    others = controls.withColumn("bj", own(nj)).withColumn("bi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ni - 1).cast("long"))))
    run, kind = _log_sums(n_periods, unit)
    moved = dealt.groupBy("bi", "bj").cogroup(others.groupBy("bi", "bj")).applyInArrow(run, kind)

    def added(value: Column) -> list[Column]:
        return [F.sum(value).alias("s"), F.count(value).alias("n")]

    value = lambda y0: F.when((F.col("y") > 0) & (y0 > 0), F.log("y") - F.log(y0))
    without = moved.groupBy("left_out", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = rows.groupBy("at").agg(*added(value(F.col("y0"))))
    mine = rows.groupBy("unit", "at").agg(*added(value(F.col("y0")))).withColumnsRenamed({"s": "s_own", "n": "n_own"})
    treated = cells.where("ever = 1").select("unit").distinct().join(F.broadcast(total)).join(mine, ["unit", "at"], "left")
    treated = treated.select(F.col("unit").alias("left_out"), "at", (F.coalesce("s", F.lit(0.0)) - F.coalesce("s_own", F.lit(0.0))).alias("s"), (F.col("n") - F.coalesce("n_own", F.lit(0))).alias("n"))
    # controls that are observed nowhere move nothing
    idle = cells.where("ever = 0").select(F.col("unit").alias("left_out")).distinct().join(deltas.select(F.col("unit").alias("left_out")).distinct(), "left_out", "left_anti")
    out = without.unionByName(idle.join(F.broadcast(total)).select("left_out", "at", "s", "n"))
    if alone is not None:
        again = _refitted(cells, alone).join(rows.drop("y0"), ["unit", "time_ix"])
        again = again.groupBy("left_out", "at").agg(*added(value(F.col("y") - F.col("eff"))))
        out = out.join(F.broadcast(alone), "left_out", "left_anti").unionByName(again)
    return out.unionByName(treated).where("n > 0").withColumn("job_id", F.xxhash64("left_out")).drop("left_out")


def _cell_moves(n_periods: int, unit: DataType, cells: StructType):
    def run(key: tuple, asked: pa.Table, left: pa.Table) -> pa.Table:
        """``asked`` with reps: for each unit of ``left``, what its absence adds to the cell's effect."""
        names = [f.name for f in cells]
        row, t, share = _flat(asked, "shares", "t", "share")
        weight = np.zeros((asked.num_rows, n_periods))
        weight[row, t] = share
        of, when, value = _flat(left, "deltas", "t", "delta")
        delta = np.zeros((left.num_rows, n_periods))
        delta[of, when] = value
        at, who = asked.column("time_ix").to_numpy() - 1, left.column("left_out").combine_chunks()
        parts = []
        for low in range(0, asked.num_rows if left.num_rows else 0, AT_ONCE):
            part = asked.select(names).slice(low, AT_ONCE)
            on = slice(low, low + part.num_rows)
            moved = weight[on] @ delta.T - delta[:, at[on]].T
            pairs = pa.StructArray.from_arrays([who.take(pa.array(np.tile(np.arange(len(who)), part.num_rows))), pa.array(moved.ravel())], ["left_out", "moved"])
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(who))
            parts.append(part.append_column("reps", pa.ListArray.from_arrays(offsets, pairs)))
        kind = pa.list_(pa.struct([("left_out", who.type), ("moved", pa.float64())]))
        return pa.concat_tables(parts) if parts else asked.select(names).slice(0, 0).append_column("reps", pa.array([], kind))

    pair = StructType([StructField("left_out", unit), StructField("moved", DoubleType())])
    return run, StructType([*cells.fields, StructField("reps", ArrayType(pair))])


def cell_replicates(cells: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (unit, time_ix, eff and more) once for every unit left out (left_out), with that replicate's eff, its job_id and n_drawn 1.

    A control that is left out moves an effect at t by -delta_t plus the mean of delta over the unit's own periods; a treated unit takes only
    its own rows away. Blocks of rows meet blocks of units, each pair of blocks a group of its own: what is shuffled are rows and units, once for
    each block of the others, and their pairs are made last."""
    unit = cells.schema["unit"].dataType
    cells = _before(cells)
    deltas, alone = _deltas(cells)
    n_periods = int(cells.agg(F.max("time_ix")).first()[0])
    t = (F.col("time_ix") - 1).alias("t")
    asked = rows.join(_shares(cells).groupBy("unit").agg(F.collect_list(F.struct(t, "share")).alias("shares")), "unit", "left")
    # treated units, and controls that are observed nowhere, move nothing
    moves = deltas.groupBy(F.col("unit").alias("left_out")).agg(F.collect_list(F.struct(t, "delta")).alias("deltas"))
    left = cells.select(F.col("unit").alias("left_out")).distinct().join(moves, "left_out", "left")
    if alone is not None:
        left = left.join(F.broadcast(alone), "left_out", "left_anti")
    ni, nj = (max(1, -(-n // block)) for n in (rows.count(), cells.select("unit").distinct().count()))
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = asked.withColumn("bi", F.pmod(F.xxhash64("unit", "time_ix"), F.lit(ni))).withColumn("bj", blocks(nj))
    others = left.withColumn("bj", F.pmod(F.xxhash64("left_out"), F.lit(nj))).withColumn("bi", blocks(ni))
    run, kind = _cell_moves(n_periods, unit, rows.schema)
    met = dealt.groupBy("bi", "bj").cogroup(others.groupBy("bi", "bj")).applyInArrow(run, kind).withColumn("reps", F.explode("reps"))
    out = met.where("unit <> reps.left_out").withColumn("left_out", F.col("reps.left_out")).withColumn("eff", F.col("eff") + F.col("reps.moved")).drop("reps")
    if alone is not None:
        out = out.unionByName(rows.drop("eff").join(_refitted(cells, alone), ["unit", "time_ix"]))
    return out.withColumn("job_id", F.xxhash64("left_out")).withColumn("n_drawn", F.lit(1))
