"""The parametric bootstrap: simulated prediction errors, their moments with gaps, and draws without a fit of their own."""

import numpy as np
import pandas as pd
import pytest

from tessera.plans import inference, jobs
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec

SPEC = PanelSpec(y="y", d="d", unit="id", time="time")
N, T, TREATED, ONSET = 30, 16, 8, 11


def panel(spark, rho=0.8, missing=0.0, seed=0):
    rng = np.random.default_rng(seed)
    e = np.zeros((T, N))
    for t in range(T):
        e[t] = (rho * e[t - 1] if t else 0) + rng.normal(0, np.sqrt(1 - rho**2) if t else 1, N)
    y = e + rng.normal(size=N) * 2 + np.linspace(0, 3, T)[:, None]
    d = np.zeros((T, N), int)
    d[ONSET:, :TREATED] = 1
    y += 2.0 * d
    rows = [(i, t + 1, float(y[t, i]), int(d[t, i])) for i in range(N) for t in range(T) if rng.random() >= missing or t in (0, ONSET, T - 1)]
    return spark.createDataFrame(rows, "id long, time int, y double, d int")


def test_second_moments_and_factor():
    rng = np.random.default_rng(1)
    paths = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    paths[rng.random(paths.shape) < 0.3] = np.nan
    got = inference.second_moments(paths)
    for s in range(5):
        for t in range(5):
            both = np.isfinite(paths[:, s]) & np.isfinite(paths[:, t])
            assert abs(got[s, t] - (paths[both, s] * paths[both, t]).mean()) < 1e-12
    assert inference.second_moments(np.full((3, 2), np.nan)).tolist() == [[0, 0], [0, 0]]
    broken = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    factor = inference.noise_factor(broken)
    values = np.linalg.eigvalsh(broken)
    near = factor @ factor.T
    assert values.min() < 0 and np.linalg.eigvalsh(near).min() > -1e-12
    # no other semi-definite matrix is nearer: what was cut is the negative part
    assert abs(np.linalg.norm(near - broken) - np.linalg.norm(values[values < 0])) < 1e-9
    assert np.allclose(inference.noise_factor(got) @ inference.noise_factor(got).T, got) or np.linalg.eigvalsh(got).min() < 0


def test_drawn_paths_keep_serial_correlation():
    rng = np.random.default_rng(2)
    t = np.arange(6)
    root = np.linalg.cholesky(0.8 ** np.abs(t[:, None] - t[None, :]))
    paths = rng.normal(size=(4000, 6)) @ root.T
    paths[rng.random(paths.shape) < 0.25] = np.nan
    rows = pd.DataFrame({"job_id": np.arange(4000), "k": 3, "path": list(paths)})
    drawn = inference._drawn_paths(True, 6000, 7)(rows)
    moments = np.stack(drawn["path"].to_list()).T @ np.stack(drawn["path"].to_list()) / 6000
    assert np.abs(moments - root @ root.T).max() < 0.1 and set(drawn["k"]) == {3} and drawn["job_id"].tolist() == list(range(6000))
    whole = inference._drawn_paths(False, 50, 7)(rows[:20])
    assert all(any(np.array_equal(x, y, equal_nan=True) for y in paths[:20]) for x in whole["path"])


def test_errors_come_from_one_fit_for_all_treated_units(spark, monkeypatch):
    p = jobs.dense(fit(panel(spark), SPEC, FitOptions(sample="nevertreated")).cells)
    calls = []
    own = jobs.fit_dense

    def counted(q, **arguments):
        calls.append(q)
        return own(q, **arguments)

    monkeypatch.setattr(jobs, "fit_dense", counted)
    arguments = inference._fit_arguments(FitOptions(sample="nevertreated"), False)
    rows = dict(inference._error_paths(p, "errors", {"seed": 3, "fit": arguments}))
    assert len(calls) == 1 and sorted(rows) == list(range(TREATED))
    q = calls[0]
    mean = q.y[:, TREATED:].mean(axis=1)
    fake = q.y[:, 0]
    want = fake - mean - (fake - mean)[:ONSET].mean()
    assert all(np.abs(np.array(rows[k]) - want).max() < 1e-8 for k in rows)
    # a draw itself fits nothing
    calls.clear()
    whole = p.take(np.arange(N))
    whole.fitted = own(p, **arguments).y0
    out = inference._parametric(whole, {"seed": 1, "paths": {k: np.zeros(T) for k in range(TREATED)}})
    assert not calls and np.allclose(out.y[:, :TREATED], np.where(p.d[:, :TREATED] == 1, p.y[:, :TREATED], whole.fitted[:, :TREATED]))
    with pytest.raises(ValueError, match="no error path"):
        inference._parametric(whole, {"seed": 1, "paths": {}})


def test_gaps_leave_serial_correlation_in_the_standard_error(spark):
    """With correlated errors the mean effect varies more than independent errors of the same size would make it."""
    options = FitOptions(sample="nevertreated", method="gsc", r=0, min_t0=1)
    se = {}
    for rho in (0.8, 0.0):
        got = fit(panel(spark, rho, missing=0.12, seed=5), SPEC, options, se=True, vartype="parametric", nboots=120)
        row = got.intervals().where("kind = 'overall'").first()
        assert row["n_reps"] == 120 and abs(row["value"] - 2.0) < 1.5
        se[rho] = row["se"]
    assert 1.2 < se[0.8] / se[0.0] < 4


def test_balanced_draws_resample_whole_paths(spark):
    options = FitOptions(sample="nevertreated", method="gsc", r=0, min_t0=1)
    got = fit(panel(spark, 0.5, seed=8), SPEC, options, se=True, vartype="parametric", nboots=60)
    jack = fit(panel(spark, 0.5, seed=8), SPEC, options, se=True, vartype="jackknife")
    a, b = (x.intervals().where("kind = 'overall'").first()["se"] for x in (got, jack))
    assert 0.5 < a / b < 2
    again = fit(panel(spark, 0.5, seed=8), SPEC, options, se=True, vartype="parametric", nboots=60)
    assert abs(again.intervals().where("kind = 'overall'").first()["se"] - a) < 1e-9
