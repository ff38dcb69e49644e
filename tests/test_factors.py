"""Factor and penalised models over the units' rows, against the dense kernels."""

import numpy as np
import pytest

from tessera.operators import factors, panel
from tessera.plans import jobs
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec
from tessera.sources import simulate, stored

SPEC = PanelSpec(y="y", d="d", unit="id", time="time")
N, T = 24, 14


def made(spark, seed=1, weights=False):
    """Two factors, two covariates, gaps, and treatment of a third of the units."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(2, T, N))
    y = rng.normal(size=N) + np.linspace(0, 2, T)[:, None] + 3 * rng.normal(size=(T, 2)) @ rng.normal(size=(2, N)) + 0.7 * x[0] - x[1] + rng.normal(0, 0.2, (T, N))
    rows = [(i, t + 1, float(y[t, i]), int(i < 8 and t >= 9 + i % 2), float(x[0, t, i]), float(x[1, t, i]), float(rng.integers(1, 4))) for i in range(N) for t in range(T) if rng.random() > 0.05]
    spec = PanelSpec(y="y", d="d", unit="id", time="time", x=("a", "b"), weight="w" if weights else None)
    df = spark.createDataFrame(rows, "id long, time int, y double, d int, a double, b double, w double")
    return df, spec, stored.stored(panel.prepare(df, spec, FitOptions(min_t0=1)), "unit")


def surface(out, p):
    rows = {(r["unit"], r["time_ix"]): r["y0"] for r in out.select("unit", "time_ix", "y0").collect()}
    return np.array([[np.nan if rows[u, t] is None else rows[u, t] for u in p.units] for t in p.index])


@pytest.mark.parametrize("force, r, weighted", [("two-way", 2, False), ("unit", 1, False), ("time", 1, False), ("two-way", 1, True)])
def test_factors_equal_the_kernel(spark, force, r, weighted):
    _, _, cells = made(spark, weights=weighted)
    p = jobs.dense(cells, ("x1", "x2"))
    out, sides, loadings = factors.fit(cells, ("x1", "x2"), r=r, force=force, weighted=weighted, tol=1e-9)
    want = jobs.fit_dense(p, "ife", force, r=r, tol=1e-11, max_iter=100000, weighted=weighted)
    got = surface(out, p)
    w = np.where(p.use, p.w if weighted else 1.0, 0.0)
    loss = [float((w * np.where(p.use, p.y - y0, 0.0) ** 2).sum()) for y0 in (got, want.y0)]
    assert sides.converged and abs(loss[0] - loss[1]) < 1e-5 * loss[1]
    assert np.abs(got - want.y0)[p.obs].max() < 1e-3 and np.abs(sides.beta - want.beta).max() < 1e-4
    assert np.allclose(sides.factors.T @ sides.factors / T, np.eye(r)) and loadings.count() == N
    assert sides.n_cells == int(p.use.sum()) and abs(sides.ssr - loss[0]) < 1e-4 * loss[0]


@pytest.mark.parametrize("share", [0.8, 0.3])
def test_penalty_equals_the_kernel(spark, share):
    """At 0.3 of the largest penalty more than the working rank of four may be left."""
    df = simulate.simulated(spark, n=N, t=T, n_treated=8, onset=9, tau=2.0, factors=2, noise=1.0, seed=3)
    cells = stored.stored(panel.prepare(df, SPEC, FitOptions(min_t0=1)), "unit")
    p = jobs.dense(cells)
    from tessera.functions import kernels

    top = kernels.largest_penalty(p.y, p.use, p.x, "two-way")
    assert abs(factors.largest_penalty(cells) - top) < 1e-9 * top
    out, sides, _ = factors.fit(cells, lam=share * top, tol=1e-8)
    want = jobs.fit_dense(p, "mc", lam=share * top, tol=1e-11, max_iter=100000)
    assert np.abs(surface(out, p) - want.y0).max() < 2e-3
    low = want.y0 - kernels.additive(want.y0, "two-way")
    assert np.linalg.matrix_rank(low, tol=1e-6) >= 1 and sides.converged


@pytest.mark.parametrize("force, arguments", [("two-way", {"r": 2}), ("unit", {"r": 1}), ("time", {"r": 1}), ("two-way", {"lam": 0.01}), ("two-way", {"lam": 1e9}), ("two-way", {"r": 1, "on_controls": True})])
def test_moments_equal_passes(spark, monkeypatch, force, arguments):
    """Steps from the moments of each set of used periods are the steps of passes over the units; with moments there is no pass."""
    _, _, cells = made(spark)
    few, passes = {"tol": 0.0, "max_iter": 4} | arguments, factors._sums_of_pass
    monkeypatch.setattr(factors, "_sums_of_pass", lambda *a: pytest.fail("a pass over the units"))
    near = factors.fit(cells, force=force, **few)
    monkeypatch.setattr(factors, "_sums_of_pass", passes)
    monkeypatch.setattr(factors, "MAX_MOMENTS", 14 * 16 * 2)  # more than two sets of periods are used
    far = factors.fit(cells, force=force, **few)
    a, b = ({(r["unit"], r["time_ix"]): r["y0"] for r in x[0].select("unit", "time_ix", "y0").collect()} for x in (near, far))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a)
    assert near[1].ssr == pytest.approx(far[1].ssr, rel=1e-7) and (near[1].n_cells, near[1].n_units, near[1].n_iter) == (far[1].n_cells, far[1].n_units, far[1].n_iter)


def test_fit_routes(spark, monkeypatch):
    df, spec, _ = made(spark)
    near = fit(df, spec, FitOptions(method="ife", r=2, min_t0=1, tol=1e-10, max_iter=50000))
    far = fit(df, spec, FitOptions(method="ife", r=2, min_t0=1, tol=1e-8, distributed=True))
    a, b = ({r["event_time"]: r["att"] for r in x.event().collect()} for x in (near, far))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 for k in a)
    assert far.panel is None and near.panel is not None and far.times.count() == T and far.units.count() == N
    assert abs(far.scalars["sigma2"] - near.scalars["sigma2"]) < 1e-4 * near.scalars["sigma2"] and abs(far.scalars["ic"] - near.scalars["ic"]) < 1e-3
    monkeypatch.setattr(jobs, "MAX_PANEL_BYTES", 1000)  # a panel too large for one process
    large = fit(df, spec, FitOptions(method="mc", lam=0.01, min_t0=1))
    assert large.panel is None and large.event().count() == len(a)
    with pytest.raises(ValueError, match="dense panel"):
        fit(df, spec, FitOptions(method="ife", r=(0, 2), min_t0=1))
    with pytest.raises(ValueError, match="distributed fits"):
        fit(df, spec, FitOptions(method="cfe", min_t0=1, distributed=True))
