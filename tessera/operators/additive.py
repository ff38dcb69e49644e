"""Additive counterfactuals: group means, the never-treated closed form, and exact two-way least squares.

All of it is plain aggregation but the two-way fit, whose units are partialled out where they lie: each partition adds
up one (T + p)-square matrix, Spark sums these, and only the sum reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Periods plus covariates of an exact fit: its matrix has the square of that.
MAX_SYSTEM = 4000


def with_means(cells: DataFrame, force: str) -> DataFrame:
    """Add y0 as the grand, unit or period mean of the usable cells (no effects, or effects of one kind)."""
    if force == "two-way":
        raise ValueError("two-way effects need exact_fit or never_treated")
    usable = F.when(F.col("ii") == 1, F.col("y"))
    if force == "none":
        mean = cells.agg(F.avg(usable).alias("y0"))
        return cells.join(F.broadcast(mean))
    if force == "unit":
        return cells.withColumn("y0", F.avg(usable).over(W.partitionBy("unit")))
    # a row a period; the number of periods is checked when the panel is made
    means = cells.groupBy("time_ix").agg(F.avg(usable).alias("y0"))
    return cells.join(F.broadcast(means), "time_ix")


def controls_balanced(cells: DataFrame) -> bool:
    """Whether every never-treated unit is observed in every period, which the closed form needs."""
    return cells.where((F.col("ever") == 0) & (F.col("i_obs") == 0)).limit(1).count() == 0


def never_treated(cells: DataFrame, force: str = "two-way") -> DataFrame:
    """Add y0 fitted on never-treated units: the period's control mean plus the unit's average distance to it
    before treatment (treatment counts as absorbing)."""
    control = F.when((F.col("ever") == 0) & (F.col("i_obs") == 1), F.col("y"))
    if force in ("time", "two-way"):
        means = cells.groupBy("time_ix").agg(F.avg(control).alias("m"))
        out = cells.join(F.broadcast(means), "time_ix")
    else:
        out = cells.join(F.broadcast(cells.agg(F.avg(control).alias("m"))))
    if force in ("unit", "two-way"):
        first = F.min(F.when(F.col("d") == 1, F.col("time_ix"))).over(W.partitionBy("unit"))
        out = out.withColumn("__first", first)
        own = F.when((F.col("i_obs") == 1) & (F.col("ii") == 1) & (F.col("__first").isNull() | (F.col("time_ix") < F.col("__first"))), F.col("y") - F.col("m"))
        out = out.withColumn("y0", F.col("m") + F.avg(own).over(W.partitionBy("unit"))).drop("__first")
    else:
        out = out.withColumn("y0", F.col("m"))
    return out.drop("m")


def _partials(size: int, n_periods: int, x: tuple[str, ...]):
    """Per partition and key the (size, size + 1) normal equations of units partialled out, a row of the matrix a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lists = batch.column("k").to_numpy(), batch.column("c")
            flat = lists.flatten()
            of = np.repeat(np.arange(len(key)), lists.value_lengths().to_numpy())
            column = lambda name: flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float)
            t, w = column("t").astype(np.int64), column("w")
            values = np.column_stack([*(column(c) for c in x), column("y")])
            step = max(1, (1 << 22) // max(size, 1))  # units whose dense rows fit at once
            for k in np.unique(key).tolist():
                total = totals.setdefault(k, np.zeros((size, size + 1)))
                for low in range(0, len(key), step):
                    on = np.flatnonzero((of >= low) & (of < low + step) & (key[of] == k))
                    if not len(on):
                        continue
                    unit, n = of[on] - low, min(step, len(key) - low)
                    sums = np.zeros((n, size + 1))
                    np.add.at(sums, (unit, t[on]), w[on])
                    v, at = values[on], w[on]
                    for j in range(v.shape[1]):
                        sums[:, n_periods + j] = np.bincount(unit, at * v[:, j], n)
                    weight = np.maximum(np.bincount(unit, at, n), 1e-300)
                    total -= sums[:, :-1].T @ (sums / weight[:, None])
                    total[np.arange(n_periods), np.arange(n_periods)] += np.bincount(t[on], at, n_periods)
                    for j in range(v.shape[1]):
                        by_time = np.bincount(t[on], at * v[:, j], n_periods)
                        total[:n_periods, n_periods + j] += by_time
                        if j < len(x):
                            total[n_periods + j, :n_periods] += by_time
                    total[n_periods:, n_periods:] += (v[:, : len(x)] * at[:, None]).T @ v
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k), pa.int64()), pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "i", "v"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.stack(table.column("v").to_pylist()).sum(axis=0)
    return pa.table({"k": table.column("k").slice(0, 1), "i": table.column("i").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})


def normal_equations(rows: DataFrame, n_periods: int, x: tuple[str, ...] = (), weight: str | None = None, key: str | None = None) -> DataFrame:
    """(k, i, v): row i of the normal equations of each key's two-way regression of y on period dummies and ``x``, units
    partialled out, with the right side as the last value. Partitions send one packed matrix each; its rows are
    summed apart from each other."""
    size = n_periods + len(x)
    if size > MAX_SYSTEM:
        raise ValueError(f"an exact fit of {size} periods and covariates exceeds {MAX_SYSTEM}")
    k = F.col(key).cast("long") if key else F.lit(0).cast("long")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    units = rows.groupBy(k.alias("k"), "unit").agg(F.collect_list(F.struct((F.col("time_ix") - 1).alias("t"), w.alias("w"), *(F.col(c).cast("double").alias(c) for c in x), F.col("y").cast("double").alias("y"))).alias("c"))
    kind = "k long, i int, v array<double>"
    return units.select("k", "c").mapInArrow(_partials(size, n_periods, x), kind).groupBy("k", "i").applyInArrow(_summed, kind)


def exact_fit(cells: DataFrame, x: tuple[str, ...] = (), weighted: bool = False, on_controls: bool = False) -> tuple[DataFrame, dict]:
    """Add y0 by exact two-way least squares on the usable cells; also the period effects and coefficients.

    Raises where units and periods aren't connected by usable cells, or a covariate is not identified."""
    n_periods = cells.agg(F.max("time_ix")).first()[0]
    size = n_periods + len(x)
    usable = (F.col("ii") == 1) & ((F.col("ever") == 0) if on_controls else F.lit(True))
    rows = cells.where(usable)
    w = F.col("w") if weighted else F.lit(1.0)
    sums = normal_equations(rows, n_periods, x, "w" if weighted else None).toArrow()  # one matrix of checked size
    a = np.zeros((size, size + 1))
    if sums.num_rows:
        a[sums.column("i").to_numpy()] = np.stack(sums.column("v").to_pylist())
    gram, b = a[:, :-1], a[:, -1]
    present = np.diag(gram)[:n_periods] > 1e-12 * max(np.diag(gram)[:n_periods].max(initial=0.0), 1e-300)
    used = np.append(np.flatnonzero(present), np.arange(n_periods, size))
    g = gram[np.ix_(used, used)]
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    values, vectors = np.linalg.eigh(g / np.outer(scale, scale))
    null = values < 1e-10 * max(values.max(initial=0), 1e-300)
    if null.sum() != 1:
        raise ValueError("units and periods aren't connected by usable cells, or a covariate isn't identified")
    inverse = (vectors[:, ~null] / values[~null]) @ vectors[:, ~null].T / np.outer(scale, scale)
    solved = inverse @ b[used]
    xi, beta = np.zeros(n_periods), solved[int(present.sum()) :]
    xi[present] = solved[: int(present.sum())]
    xi[present] -= xi[present].mean()
    spark = cells.sparkSession
    effects = spark.createDataFrame([(int(t) + 1, float(v) if present[t] else None) for t, v in enumerate(xi)], "time_ix int, xi double")
    part = F.col("xi")
    for name, value in zip(x, beta.tolist(), strict=True):
        part = part + F.lit(value) * F.col(name)
    out = cells.join(F.broadcast(effects), "time_ix").withColumn("__part", part)
    own = F.when(F.col("ii") == 1, F.col("y") - F.col("__part"))
    weight = F.when(own.isNotNull(), w)
    by_unit = W.partitionBy("unit")
    out = out.withColumn("alpha", F.sum(own * weight).over(by_unit) / F.sum(weight).over(by_unit)).withColumn("y0", F.col("alpha") + F.col("__part"))
    return out.drop("__part"), {"xi": xi, "beta": beta, "gram": g, "used": used}
