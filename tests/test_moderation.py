"""The moderation refit: theta(m) against both models fitted by least squares."""

import numpy as np
import pytest

from tessera.plans import jobs, moderation, plotdata
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec

SPEC = PanelSpec(y="y", d="d", unit="id", time="time", x=("m", "z"))
N, T, ONSET = 20, 12, 7


def panel(spark, seed=0, noise=0.05):
    """Effects are 1 + 2 m: the moderator's coefficient is 0.5 before and 2.5 under treatment."""
    rng = np.random.default_rng(seed)
    m, z, e = rng.normal(size=(T, N)), rng.normal(size=(T, N)), rng.normal(0, noise, (T, N))
    d = np.zeros((T, N), int)
    for i in range(9):
        d[ONSET + i % 3 :, i] = 1
    y = rng.normal(size=N)[None, :] + np.linspace(0, 1, T)[:, None] + 0.5 * m - z + d * (1 + 2 * m) + e
    rows = [(i, t + 1, float(y[t, i]), int(d[t, i]), float(m[t, i]), float(z[t, i])) for i in range(N) for t in range(T) if (i, t) != (3, 8)]
    return spark.createDataFrame(rows, "id long, time int, y double, d int, m double, z double")


def by_hand(p, levels):
    """Dummy regressions on untreated and on treated cells."""

    def surface(use):
        t, i = np.nonzero(use)
        design = np.zeros((len(t), T + N + 2))
        design[np.arange(len(t)), t] = design[np.arange(len(t)), T + i] = 1
        design[:, -2:] = p.x[t, i]
        b = np.linalg.lstsq(design, p.y[t, i], rcond=None)[0]
        return b[:T][:, None] + b[T : T + N][None, :] + p.x[:, :, 1] * b[-1], b[-2]

    treated = p.obs & (p.d == 1)
    (g0, b0), (g1, b1) = surface(p.use), surface(treated)
    return [float((g1 - g0)[treated].mean() + level * (b1 - b0)) for level in levels]


def test_theta_is_the_difference_of_two_regressions(spark):
    got = fit(panel(spark), SPEC, FitOptions(min_t0=1))
    p = jobs.dense(got.cells, ("x1", "x2"))
    levels = (-1.0, 0.0, 0.5, 2.0)
    rows = {r["level"]: r for r in moderation.theta(got, "m", levels).collect()}
    for level, want in zip(levels, by_hand(p, levels), strict=True):
        assert abs(rows[level]["theta"] - want) < 1e-8 and abs(want - (1 + 2 * level)) < 0.4
    assert {r["n_cells"] for r in rows.values()} == {int((p.obs & (p.d == 1)).sum())}
    every = plotdata.plot_data(got, "heterogeneous", covariate="m", moderation=True)
    assert every.count() == int((p.obs & (p.d == 1)).sum())  # each treated cell has a value of its own


def test_job_route_and_intervals(spark):
    df = panel(spark, 3)
    got = fit(df, SPEC, FitOptions(min_t0=1))
    job = fit(df, SPEC, FitOptions(min_t0=1, method="ife", r=0, tol=1e-12, max_iter=20000))
    a, b = ({r["level"]: r["theta"] for r in moderation.theta(x, "m", (0.0, 1.0)).collect()} for x in (got, job))
    assert all(abs(a[k] - b[k]) < 1e-4 for k in a)
    rows = {r["at"]: r for r in moderation.theta_intervals(got, "m", (0.0, 1.0), nboots=20).collect()}
    for level, want in ((0.0, 1.0), (1.0, 3.0)):
        r = rows[level]
        assert r["n_reps"] >= 18 and 0 < r["se"] < 0.5 and r["ci_low"] - 0.2 < want < r["ci_high"] + 0.2


def test_refusals(spark):
    got = fit(panel(spark), SPEC, FitOptions(min_t0=1))
    with pytest.raises(ValueError, match="covariate"):
        moderation.theta(got, "q")
    never = fit(panel(spark), SPEC, FitOptions(min_t0=1, sample="nevertreated", method="gsc", r=0))
    with pytest.raises(ValueError, match="not-yet-treated"):
        moderation.theta(never, "m")
