"""Fan-out of independent model fits: a table of jobs, one kernel call each, over one broadcast panel.

A job is a row (job_id, kind, params as JSON). The panel's dense arrays travel once to each executor as a broadcast,
whose size is checked; ``applyInPandas`` runs a job where its row lands. A failed job gives a row with its
error instead of failing the others."""

from __future__ import annotations

import json
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

#: Bytes of dense arrays that may be broadcast.
MAX_PANEL_BYTES = 512 << 20
#: Bytes of dense arrays beyond which a fit that has another way isn't collected: its rows take many times that on the driver.
DRIVER_BYTES = 32 << 20


@dataclass
class Dense:
    """A panel as periods x units arrays."""

    units: list
    times: list
    y: np.ndarray
    d: np.ndarray
    obs: np.ndarray
    use: np.ndarray
    w: np.ndarray
    x: np.ndarray
    t_on: np.ndarray
    t_off: np.ndarray
    group: list = field(default_factory=list)
    cluster: list = field(default_factory=list)
    levels: list[np.ndarray] = field(default_factory=list)
    z: np.ndarray | None = None
    time_group: np.ndarray | None = None
    q: np.ndarray | None = None
    unit_group: np.ndarray | None = None
    #: The periods' own numbers, ascending.
    index: list[int] = field(default_factory=list)
    #: Of a whole panel that a parametric bootstrap draws from: the model's untreated outcomes, and the factor of the controls' error
    #: covariance where cells are missing. Parts taken from the panel don't carry them.
    fitted: np.ndarray | None = None
    noise: np.ndarray | None = None

    @property
    def ever(self) -> np.ndarray:
        return (self.d == 1).any(axis=0)

    def take(self, columns: np.ndarray) -> Dense:
        """The panel of these units, with repeats."""
        pick = lambda a: a[:, columns]
        return Dense(
            [self.units[i] for i in columns], self.times, *(pick(a) for a in (self.y, self.d, self.obs, self.use, self.w)), self.x[:, columns], pick(self.t_on), pick(self.t_off),
            [self.group[i] for i in columns], [self.cluster[i] for i in columns], [c[:, columns] for c in self.levels],
            None if self.z is None else self.z[columns], self.time_group, self.q, None if self.unit_group is None else self.unit_group[columns], self.index)


def dense_bytes(cells: DataFrame, extra: int = 0) -> int:
    return cells.count() * (7 + extra) * 8


def dense(cells: DataFrame, x: tuple[str, ...] = ()) -> Dense:
    """Collect a panel whose size is checked first. Missing cells are NaN and not observed."""
    extra = [c for c in cells.columns if c.startswith(("fe", "z", "q")) and c[-1].isdigit()] + [c for c in ("tg", "ug") if c in cells.columns]
    size = dense_bytes(cells, len(x) + len(extra))
    if size > MAX_PANEL_BYTES:
        raise ValueError(f"a dense panel of {size >> 20} MB exceeds {MAX_PANEL_BYTES >> 20} MB; additive fits need none")
    data = cells.select("unit", "time", "time_ix", "y", "d", "i_obs", "ii", "w", "t_on", "t_off", "g", "cl", *x, *extra).toPandas()
    units = sorted(data["unit"].unique().tolist())
    order = data[["time_ix", "time"]].drop_duplicates().sort_values("time_ix")
    row = data["time_ix"].map({k: i for i, k in enumerate(order["time_ix"])}).to_numpy()
    col = data["unit"].map({u: i for i, u in enumerate(units)}).to_numpy()

    def matrix(name, fill=np.nan):
        out = np.full((len(order), len(units)), fill, float)
        out[row, col] = pd.to_numeric(data[name]).astype(float).fillna(fill).to_numpy()
        return out

    xs = np.stack([matrix(c, 0.0) for c in x], axis=2) if x else np.zeros((len(order), len(units), 0))
    first = data.sort_values("time_ix").groupby("unit")
    out = Dense(units, order["time"].tolist(), matrix("y"), matrix("d"), matrix("i_obs", 0) == 1, matrix("ii", 0) == 1, matrix("w", 1.0), xs, matrix("t_on"), matrix("t_off"), first["g"].first().reindex(units).tolist(), first["cl"].first().reindex(units).tolist())
    out.index = order["time_ix"].astype(int).tolist()
    for c in extra:
        if c.startswith("fe"):
            codes = np.zeros(out.y.shape, int)
            codes[row, col] = pd.factorize(data[c].fillna("?"))[0] + 1
            out.levels.append(codes)
    zs, qs = [c for c in extra if c.startswith("z")], [c for c in extra if c.startswith("q")]
    # traits come from the unit and period dimensions, never from filled cells
    if zs:
        out.z = np.column_stack([np.ones(len(units)), *(first[c].first().reindex(units).to_numpy(float) for c in zs)])
        out.time_group = pd.factorize(data.groupby("time_ix")["tg"].first())[0] if "tg" in extra else np.arange(len(order))
    if qs:
        per = data.groupby("time_ix")
        out.q = np.column_stack([per[c].first().to_numpy(float) for c in qs])
        out.unit_group = pd.factorize(first["ug"].first().reindex(units))[0] if "ug" in extra else np.arange(len(units))
    return out


def fit_dense(p: Dense, method: str = "fe", force: str = "two-way", sample: str = "notyettreated", r: int = 0, lam: float | None = None, tol: float = 1e-6, max_iter: int = 2000, weighted: bool = False, bound: str = "none", gamma: float | None = None, use: np.ndarray | None = None, solver: str = "svd") -> kernels.Fit:
    """One model on one dense panel."""
    use = p.use if use is None else use
    w = p.w if weighted else None
    if method == "probit":
        return kernels.probit(p.y, use, p.x, r, force, tol, max_iter, solver)
    if method == "cfe" and sample == "nevertreated":
        absorbed = np.maximum.accumulate(np.nan_to_num(p.d), axis=0) > 0
        return kernels.complex_never_treated(p.y, use, use & ~absorbed, ~p.ever, p.x, r, force, tol, max_iter, p.levels, p.z, p.time_group, p.q, p.unit_group, w)
    if method == "cfe":
        return kernels.complex_effects(p.y, use, p.x, r, force, tol, max_iter, p.levels, p.z, p.time_group, p.q, p.unit_group, w)
    if sample == "nevertreated":
        absorbed = np.maximum.accumulate(np.nan_to_num(p.d), axis=0) > 0
        return kernels.never_treated(p.y, use, use & ~absorbed, ~p.ever, p.x, 0 if method == "fe" else r, force, tol, max_iter, w, bound, gamma)
    if method == "mc":
        return kernels.interactive(p.y, use, p.x, 0, force, tol, max_iter, w, lam if lam is not None else 0.0)
    return kernels.interactive(p.y, use, p.x, 0 if method == "fe" else r, force, tol, max_iter, w)


def event_table(p: Dense, eff: np.ndarray, weights: bool = False) -> list[tuple[str, float, float, int]]:
    """(kind, at, value, n_cells): overall, by event time, by exit time and by period."""
    ok, treated = p.obs & np.isfinite(eff), p.d == 1
    out = []

    def add(kind, at, mask):
        on = mask & ok
        n = int(on.sum())
        if n:
            v = float((eff[on] * p.w[on]).sum() / p.w[on].sum()) if weights else float(eff[on].mean())
            out.append((kind, float(at), v, n))

    add("overall", 0, treated)
    for kind, at in (("event", p.t_on), ("exit", p.t_off)):
        for e in np.unique(at[np.isfinite(at)]):
            add(kind, e, at == e)
    for t in range(len(p.times)):
        add("calendar", t + 1, treated & (np.arange(len(p.times)) == t)[:, None])
    groups = np.array([g if g is not None else "" for g in p.group] or [""] * len(p.units))
    for k, g in enumerate(sorted(set(groups.tolist()))):
        if g:
            add(f"group:{g}", k, treated & (groups == g)[None, :])
    return out


RESULT = "job_id long, kind string, at double, value double, n_cells long, error string"


def run(p: Dense, jobs: DataFrame, kernel, spark, paths: DataFrame | None = None) -> DataFrame:
    """``kernel(panel, kind, params)`` -> rows (kind, at, value, n_cells), for every row (job_id, kind, params) of jobs.

    ``paths`` (job_id, k, path) meet the jobs that they belong to and come as params["paths"]."""
    return _fanned(p, jobs, kernel, spark, paths, RESULT, ["kind", "at", "value", "n_cells"], ("failed", 0.0, float("nan"), 0))


def _fanned(p: Dense, jobs: DataFrame, kernel, spark, paths: DataFrame | None, schema: str, names: list[str], failed: tuple) -> DataFrame:
    shared = spark.sparkContext.broadcast(p)

    def one(rows: pd.DataFrame, drawn: pd.DataFrame | None = None) -> pd.DataFrame:
        out = []
        for job in rows.itertuples():
            params = json.loads(job.params)
            if drawn is not None:
                params["paths"] = {k: np.asarray(path, float) for k, path in zip(drawn["k"], drawn["path"], strict=True)}
            try:
                out += [(job.job_id, *row, None) for row in kernel(shared.value, job.kind, params)]
            except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                out.append((job.job_id, *failed, str(e)[:200]))
        return pd.DataFrame(out, columns=["job_id", *names, "error"])

    def without(rows: pd.DataFrame) -> pd.DataFrame:
        return one(rows)

    if paths is None:
        return jobs.groupBy("job_id").applyInPandas(without, schema)
    return jobs.groupBy("job_id").cogroup(paths.groupBy("job_id")).applyInPandas(one, schema)


def run_surfaces(p: Dense, jobs: DataFrame, kernel, spark, unit_type: str, paths: DataFrame | None = None) -> DataFrame:
    """``kernel(panel, kind, params)`` -> rows (unit, n_drawn, effects by period number from 1), for every job: its surface, packed a row a unit."""
    return _fanned(p, jobs, kernel, spark, paths, f"job_id long, unit {unit_type}, n_drawn int, effects array<double>, error string", ["unit", "n_drawn", "effects"], (None, 0, None))


def run_paths(p: Dense, jobs: DataFrame, kernel, spark) -> DataFrame:
    """``kernel(panel, kind, params)`` -> rows (k, path), for every job."""
    return _fanned(p, jobs, kernel, spark, None, "job_id long, k int, path array<double>, error string", ["k", "path"], (-1, None))


def fit_remote(p: Dense, spark, **arguments) -> kernels.Fit:
    """``fit_dense`` as a job, so that the driver's process doesn't compute."""
    shared = spark.sparkContext.broadcast(p)

    def one(batches):
        for rows in batches:
            yield pd.DataFrame({"fit": [pickle.dumps(fit_dense(shared.value, **arguments)) for _ in range(len(rows))]})

    return pickle.loads(spark.range(1).repartition(1).mapInPandas(one, "fit binary").first()["fit"])


def table(spark, rows: list[tuple[int, str, dict]]) -> DataFrame:
    """Jobs, spread over the cores: many more partitions than jobs would only wait."""
    made = spark.createDataFrame([(i, kind, json.dumps(params)) for i, kind, params in rows], "job_id long, kind string, params string")
    return made.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), F.col("job_id"))
