"""Interactive and nuclear-norm models fitted where the units' rows lie, for panels that no single process could hold.

Least squares over used cells of y = alpha_i + xi_t + x beta + lambda_i f_t, or with rho / 2 (|lambda|^2 + |f|^2) added, whose minimum is that
of the nuclear norm with weight rho. Blocks take turns: given the periods' side (xi, f, beta), every unit solves its own alpha and lambda;
given these, the periods' side solves normal equations that are sums over units. One pass over the units is one step of both: a task
packs its units into matrices, solves them together, and sends one row of sums a period. Between passes only the periods' side is kept, on
the driver, whose size is checked: nothing of a unit is written, so a lost task is run again from the stored table.

Without weights and covariates no pass is needed at all: units that are used in the same periods share their design, so every sum over
units follows from their number and the first and second moments of their outcomes. One pass collects these moments for each set of used periods, and the
steps are taken on them. Panels with too many such sets, those with weights and those with covariates take a pass a step.

A rank that the penalty doesn't bind would cut the model short, so the nuclear-norm fit doubles its working rank until part of it is zero."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.stored import stored
from . import additive

#: Numbers in the periods' normal equations that the driver may hold: 64 M are 512 MB.
MAX_SUMS = 64_000_000
#: Numbers in the moments of all sets of used periods that the driver may hold: 2 M are 16 MB.
MAX_MOMENTS = 2_000_000
FORCES = ("unit", "time", "two-way")


@dataclass
class Sides:
    """The periods' side of the model, and how it was reached."""

    xi: np.ndarray
    factors: np.ndarray
    beta: np.ndarray
    n_iter: int = 0
    converged: bool = False
    ssr: float = np.nan
    n_cells: int = 0
    n_units: int = 0


def packed(cells: DataFrame, x: tuple[str, ...], weighted: bool, usable: str = "ii = 1") -> DataFrame:
    """One row a unit with its used cells: (unit, c: array of (t, w, y, x...)); t counts periods from 0."""
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    return cells.where(usable).groupBy("unit").agg(F.collect_list(F.struct((F.col("time_ix") - 1).alias("t"), w.alias("w"), F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in x))).alias("c"))


def _matrices(batch: pa.RecordBatch, n_periods: int, x: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (0 where unused), outcomes and covariates of the batch's units, as units x periods arrays."""
    lists = batch.column(batch.schema.get_field_index("c"))
    flat = lists.flatten()
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    column = lambda name: flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False)
    t = column("t").astype(np.int64)
    out = []
    for name in ("w", "y", *x):
        a = np.zeros((len(lists), n_periods))
        a[of, t] = column(name)
        out.append(a)
    return out[0], out[1], np.stack(out[2:], axis=2) if x else np.zeros((len(lists), n_periods, 0))


@dataclass
class Moments:
    """Per set of used periods, zero outside it: its periods (k x T), the number of its units (k), sums of outcomes (k x T) and of their
    products (k x T x T). Outcomes are less ``centre``, so that products lose few digits."""

    used: np.ndarray
    n: np.ndarray
    first: np.ndarray
    second: np.ndarray
    centre: float

    def about(self, xi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second moments of outcomes less the period effects ``xi``."""
        level = self.used * (xi - self.centre)
        moved = self.n[:, None] * level
        cross = self.first[:, :, None] * level[:, None, :]
        return self.first - moved, self.second - cross - cross.transpose(0, 2, 1) + moved[:, :, None] * level[:, None, :]


def moments(units: DataFrame, n_periods: int) -> Moments | None:
    """The moments of packed ``units`` without weights and covariates; None where their sets of used periods are too many."""
    most = MAX_MOMENTS // (n_periods * (n_periods + 2))
    found = units.select(F.array_sort(F.transform("c", lambda c: c["t"])).alias("set")).distinct().limit(most + 1).toArrow().column("set").to_pylist()
    if not found or len(found) > most:
        return None
    used = np.zeros((len(found), n_periods))
    for k, periods in enumerate(found):
        used[k, periods] = 1.0
    of = {row.astype(bool).tobytes(): k for k, row in enumerate(used)}
    centre = float(units.select(F.explode("c.y").alias("y")).agg(F.avg("y")).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            w, y, _ = _matrices(batch, n_periods, ())
            keys = np.array([of[row.tobytes()] for row in w > 0])
            for k in np.unique(keys):
                z = np.where(w[keys == k] > 0, y[keys == k] - centre, 0.0)
                part = np.concatenate([z.T @ z, z.sum(axis=0)[:, None], np.full((n_periods, 1), float(len(z)))], axis=1)
                total[k] = total[k] + part if k in total else part
        for k, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n_periods, k), pa.int64()), pa.array(np.arange(n_periods), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], names=["k", "i", "v"])

    kind = "k long, i int, v array<double>"
    got = units.select("c").mapInArrow(run, kind).groupBy("k", "i").applyInArrow(additive._summed, kind).toArrow()
    rows = np.zeros((len(found), n_periods, n_periods + 2))
    rows[got.column("k").to_numpy(), got.column("i").to_numpy()] = got.column("v").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return Moments(used, rows[:, 0, -1], rows[:, :, -2], rows[:, :, :-2], centre)


def _solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum-norm solutions of many small normal equations."""
    return (np.linalg.pinv(gram, rcond=1e-11, hermitian=True) @ right[..., None])[..., 0]


def _design(sides: Sides, force: str) -> np.ndarray:
    """T x q: what a unit's own coefficients multiply."""
    t = len(sides.xi)
    return np.concatenate([np.ones((t, int(force != "time"))), sides.factors], axis=1)


def unit_side(w: np.ndarray, y: np.ndarray, x: np.ndarray, sides: Sides, force: str, rho: float) -> np.ndarray:
    """Every unit's own coefficients, by least squares on its used cells (a ridge on those of factors)."""
    g = _design(sides, force)
    q = g.shape[1]
    rest = w * (y - sides.xi - x @ sides.beta)
    gram = (w @ (g[:, :, None] * g[:, None, :]).reshape(len(g), -1)).reshape(-1, q, q)
    gram = gram + rho * np.diag(np.append(np.zeros(q - sides.factors.shape[1]), np.ones(sides.factors.shape[1])))
    return _solved(gram, rest @ g)


def _sums(sides: Sides, force: str, rho: float, n_periods: int, x: tuple[str, ...]):
    """Per task and period: the normal equations of (xi_t, f_t) and their cross sums with covariates; one more row has beta's own."""
    p, r = len(x), sides.factors.shape[1]
    q = r + int(force != "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = np.zeros((n_periods, q * q + q + q * p))
        own = np.zeros(p * p + p + 3)
        for batch in batches:
            if not batch.num_rows:
                continue
            w, y, x_ = _matrices(batch, n_periods, x)
            coef = unit_side(w, y, x_, sides, force, rho)
            alpha, load = (coef[:, :1], coef[:, 1:]) if force != "time" else (np.zeros((len(coef), 1)), coef)
            rest = y - alpha
            h = np.concatenate([np.ones((len(coef), q - r)), load], axis=1)
            per[:, : q * q] += w.T @ (h[:, :, None] * h[:, None, :]).reshape(len(h), -1)
            per[:, q * q : q * q + q] += (w * rest).T @ h
            if p:
                per[:, q * q + q :] += np.einsum("nt,nq,ntp->tqp", w, h, x_).reshape(n_periods, -1)
                own[: p * p] += np.einsum("nt,nta,ntb->ab", w, x_, x_).ravel()
                own[p * p : p * p + p] += np.einsum("nt,nt,ntp->p", w, rest, x_)
            error = rest - sides.xi - load @ sides.factors.T - x_ @ sides.beta
            own[-3:] += (w * error**2).sum(), (w > 0).sum(), len(w)
        rows = [*per, own]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows)), pa.int64()), pa.array(np.arange(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["k", "i", "v"])

    return run


def _operators(known: Moments, g: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """k x q x T: what gives the coefficients of a set's units on ``g`` from their outcomes less the period effects."""
    masked = known.used[:, :, None] * g
    gram = masked.transpose(0, 2, 1) @ masked + np.diag(ridge)
    return np.linalg.pinv(gram, rcond=1e-11, hermitian=True) @ masked.transpose(0, 2, 1)


def _sums_of_moments(known: Moments, sides: Sides, force: str, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """What the passes of ``_sums`` add up to, without covariates."""
    t, r = sides.factors.shape
    own, q = int(force != "time"), r + int(force != "unit")
    design = _design(sides, force)
    solve = _operators(known, design, np.append(np.zeros(own), np.full(r, rho)))
    first, second = known.about(sides.xi)
    load = solve[:, own:]
    mean, product = (load @ first[:, :, None])[..., 0], load @ second  # k x r, k x r x T
    h = np.zeros((len(known.n), q, q))
    h[:, q - r :, q - r :] = product @ load.transpose(0, 2, 1)
    rest = first + known.n[:, None] * known.used * sides.xi
    weighted = product + mean[:, :, None] * (known.used * sides.xi)[:, None, :]
    if own:
        alpha = solve[:, 0]
        rest = rest - (alpha * first).sum(axis=1)[:, None]
        weighted = weighted - product @ alpha[:, :, None]
    right = weighted.transpose(0, 2, 1)
    if q > r:
        h[:, 0, 0], h[:, 0, 1:], h[:, 1:, 0] = known.n, mean, mean
        right = np.concatenate([rest[:, :, None], right], axis=2)
    per = np.concatenate([known.used.T @ h.reshape(len(h), -1), (known.used[:, :, None] * right).sum(axis=0)], axis=1)
    left = known.used[:, :, None] * (np.eye(t) - design @ solve)
    ssr = ((left @ second) * left).sum()
    return per, np.array([ssr, (known.n[:, None] * known.used).sum(), known.n.sum()])


def _sums_of_pass(units: DataFrame, sides: Sides, force: str, rho: float, x: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    t = len(sides.xi)
    kind = "k long, i int, v array<double>"
    got = units.select("c").mapInArrow(_sums(sides, force, rho, t, x), kind).groupBy("k", "i").applyInArrow(additive._summed, kind).toArrow()
    by = dict(zip(got.column("i").to_pylist(), got.column("v").to_pylist(), strict=True))
    return np.stack([np.array(by[i]) for i in range(t)]), np.array(by[t])


def _step(units: DataFrame, sides: Sides, force: str, rho: float, x: tuple[str, ...], known: Moments | None = None) -> Sides:
    """One step: the periods' side after every unit has solved its own, by a pass or from the moments."""
    t, p, r = len(sides.xi), len(x), sides.factors.shape[1]
    q = r + int(force != "unit")
    if t * (q * q + q + q * p) > MAX_SUMS:
        raise ValueError(f"{t} periods with {r} factors exceed the driver's bound")
    per, own = _sums_of_pass(units, sides, force, rho, x) if known is None else _sums_of_moments(known, sides, force, rho)
    gram, right = per[:, : q * q].reshape(t, q, q), per[:, q * q : q * q + q]
    gram = gram + rho * np.diag(np.append(np.zeros(q - r), np.ones(r)))
    beta = sides.beta
    if p:
        cross = per[:, q * q + q :].reshape(t, q, p)
        inverse = np.linalg.pinv(gram, rcond=1e-11, hermitian=True)
        a = own[: p * p].reshape(p, p) - np.einsum("tqp,tqs,tsr->pr", cross, inverse, cross)
        b = own[p * p : p * p + p] - np.einsum("tqp,tqs,ts->p", cross, inverse, right)
        beta = np.linalg.pinv(a, rcond=1e-9, hermitian=True) @ b
        right = right - cross @ beta
    solved = _solved(gram, right)
    xi = solved[:, 0] if force != "unit" else np.zeros(t)
    factors = solved[:, q - r :]
    if force != "time":  # a factor's mean is the units' own level, and so is the mean of xi
        factors = factors - factors.mean(axis=0)
        xi = xi - xi.mean()
    if not rho and r:
        u, s, v = np.linalg.svd(factors, full_matrices=False)
        factors = u * np.sqrt(t)  # F'F / T = I; the units' side takes up the rest
    return Sides(xi, factors, beta, ssr=float(own[-3]), n_cells=int(own[-2]), n_units=int(own[-1]))


def _start(units: DataFrame, xi: np.ndarray, beta: np.ndarray, rank: int, force: str, x: tuple[str, ...], known: Moments | None = None) -> Sides:
    """Factors of the additive model's residuals, with unused cells at zero: the leading eigenvectors of their summed Gram matrix."""
    t = len(xi)
    gram = _residual_gram(units, Sides(xi, np.zeros((t, 0)), beta), force, x) if known is None else _gram_of_moments(known, xi, force)
    values, vectors = np.linalg.eigh(gram)
    lead = vectors[:, ::-1][:, :rank]
    return Sides(xi, lead * np.sqrt(t), beta, ssr=float(np.sqrt(max(values[-1], 0.0))))


def _gram_of_moments(known: Moments, xi: np.ndarray, force: str) -> np.ndarray:
    second = known.about(xi)[1]
    if force != "time":
        level = np.ones((len(xi), 1))
        left = known.used[:, :, None] * (np.eye(len(xi)) - level @ _operators(known, level, np.zeros(1)))
        second = left @ second @ left.transpose(0, 2, 1)
    return second.sum(axis=0)


def _residual_gram(units: DataFrame, flat: Sides, force: str, x: tuple[str, ...]) -> np.ndarray:
    t, xi, beta = len(flat.xi), flat.xi, flat.beta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((t, t))
        for batch in batches:
            if batch.num_rows:
                w, y, x_ = _matrices(batch, t, x)
                alpha = unit_side(w, y, x_, flat, force, 0.0) if force != "time" else 0.0
                e = np.where(w > 0, y - alpha - xi - x_ @ beta, 0.0)
                total += e.T @ e
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(t), pa.int64()), pa.array(np.arange(t), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "i", "v"])

    kind = "k long, i int, v array<double>"
    got = units.select("c").mapInArrow(run, kind).groupBy("k", "i").applyInArrow(additive._summed, kind).toArrow()
    gram = np.zeros((t, t))
    gram[got.column("i").to_numpy()] = np.stack(got.column("v").to_pylist())
    return gram


def largest_penalty(cells: DataFrame, x: tuple[str, ...] = (), force: str = "two-way") -> float:
    """The least penalty at which no low-rank part is left: the top singular value of the additive model's residuals over the number of cells."""
    n_periods, n_units = cells.agg(F.max("time_ix"), F.count_distinct("unit")).first()
    xi, beta = np.zeros(n_periods), np.zeros(len(x))
    if force == "two-way":
        _, info = additive.exact_fit(cells, x)
        xi, beta = info["xi"] - info["xi"].mean(), info["beta"]
    return _start(packed(cells, x, False), xi, beta, 1, force, x).ssr / (n_periods * n_units)


def _distance(a: Sides, b: Sides) -> float:
    """The larger of the relative changes of the factors' cross product, the period effects and the coefficients."""
    low = [s.factors @ s.factors.T for s in (a, b)]
    rel = lambda x, y: float(np.linalg.norm(x - y) / max(np.linalg.norm(y), 1e-12)) if np.size(y) else 0.0
    return max(rel(low[1], low[0]), rel(b.xi, a.xi), rel(b.beta, a.beta))


def fit(cells: DataFrame, x: tuple[str, ...] = (), r: int = 0, lam: float | None = None, force: str = "two-way", weighted: bool = False, tol: float = 1e-6, max_iter: int = 2000, on_controls: bool = False) -> tuple[DataFrame, Sides, DataFrame]:
    """Add y0 to cells (y, ii, w, x, unit, time_ix); also the periods' side, and (unit, loadings).

    ``r`` factors, or a nuclear-norm part of weight ``lam`` times the number of cells. Stops when the periods' side changes by ``tol`` or less
    in a pass. ``on_controls`` fits the periods' side on never-treated units; others solve their own on their cells before treatment."""
    if force not in FORCES or not (r or lam is not None):
        raise ValueError("factors are fitted with unit, time or two-way effects, and at least one of them or a penalty")
    n_periods = int(cells.agg(F.max("time_ix")).first()[0])
    rows = cells.where("ever = 0") if on_controls else cells
    units = stored(packed(rows, x, weighted), "unit")
    n_units = rows.select("unit").distinct().count()
    xi, beta = np.zeros(n_periods), np.zeros(len(x))
    if force == "two-way":
        _, info = additive.exact_fit(rows, x, weighted)
        xi, beta = info["xi"] - info["xi"].mean(), info["beta"]
    rho = lam * n_periods * n_units if lam is not None else 0.0
    rank = r if lam is None else min(n_periods, n_units, max(4, r))
    known = None if weighted or x else moments(units, n_periods)
    while True:
        sides = _start(units, xi, beta, rank, force, x, known)
        if lam is not None and force == "two-way" and not weighted and rho >= sides.ssr:
            # at the top singular value of the additive model's residuals or above, that model is the minimum
            sides = _step(units, Sides(xi, np.zeros((n_periods, 0)), beta), force, 0.0, x, known)
            sides.xi, sides.beta, sides.n_iter, sides.converged = xi, beta, 1, True
            own = _units_solved(cells, units, sides, force, 0.0, x)
            return _surface(cells, own, sides, x), sides, own.select("unit", "loadings")
        if lam is not None:
            # halve the leading part's scale between both sides, as the penalty does at its minimum
            sides.factors = sides.factors / np.sqrt(n_periods) * np.sqrt(max(sides.ssr, 1e-12))
        for i in range(1, max_iter + 1):
            new = _step(units, sides, force, rho, x, known)
            done = _distance(sides, new) <= tol
            sides, sides.n_iter = new, i
            if done:
                sides.converged = True
                break
        free = lam is None or rank >= min(n_periods, n_units) or np.linalg.svd(sides.factors, compute_uv=False)[-1] <= 1e-4 * max(1.0, float(np.abs(sides.factors).max(initial=0.0)))
        if free:
            if on_controls:
                first = F.min(F.when(F.col("d") == 1, F.col("time_ix"))).over(W.partitionBy("unit"))
                units = packed(cells.withColumn("__first", first), x, weighted, "ii = 1 and (__first is null or time_ix < __first)")
            own = _units_solved(cells, units, sides, force, rho, x)
            return _surface(cells, own, sides, x), sides, own.select("unit", "loadings")
        rank = min(2 * rank, n_periods, n_units)


def _units_solved(cells: DataFrame, units: DataFrame, sides: Sides, force: str, rho: float, x: tuple[str, ...]) -> DataFrame:
    """(unit, part, loadings): a unit's outcomes by period without covariates, and its loadings."""
    t, r = sides.factors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, y, x_ = _matrices(batch, t, x)
            coef = unit_side(w, y, x_, sides, force, rho)
            part = coef @ _design(sides, force).T + sides.xi
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("unit")), pa.array(list(part), kind), pa.array(list(coef[:, coef.shape[1] - r :]), kind)], names=["unit", "part", "loadings"])

    unit = cells.schema["unit"].dataType.simpleString()
    return units.select("unit", "c").mapInArrow(run, f"unit {unit}, part array<double>, loadings array<double>")


def _surface(cells: DataFrame, own: DataFrame, sides: Sides, x: tuple[str, ...]) -> DataFrame:
    y0 = F.get("__part", F.col("time_ix") - 1)
    for name, value in zip(x, sides.beta.tolist(), strict=True):
        y0 = y0 + F.lit(value) * F.col(name)
    return cells.join(own.select("unit", F.col("part").alias("__part")), "unit", "left").withColumn("y0", y0).drop("__part")
