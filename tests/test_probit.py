"""Probit models: both solvers, the latent variance, marginal effects with intervals, and ranks by likelihood."""

import numpy as np
import pytest

from tessera.functions import kernels, stats
from tessera.plans import cv, jobs
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec


def binary(seed=0, t=30, n=60, r=1, strength=1.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(t, n, 1))
    index = 0.3 * rng.normal(size=n) + 0.3 * rng.normal(size=t)[:, None] + 0.8 * x[:, :, 0]
    if r:
        index += strength * rng.normal(size=(t, r)) @ rng.normal(size=(r, n))
    return (index + rng.normal(size=(t, n)) > 0).astype(float), x, index


def test_alternating_regressions_are_least_squares():
    rng = np.random.default_rng(1)
    rest = rng.normal(size=(9, 14)) + rng.normal(size=(9, 2)) @ rng.normal(size=(2, 14)) * 3
    use = rng.random(rest.shape) < 0.9
    xi, factors = np.zeros(9), np.linalg.qr(rng.normal(size=(9, 2)))[0] * 3
    loss = []
    for _ in range(200):
        fitted, xi, factors, load = kernels.alternated(rest, use, xi, factors, "two-way")
        loss.append(float(((rest - fitted)[use] ** 2).sum()))
    assert all(b <= a + 1e-9 for a, b in zip(loss, loss[1:], strict=False))
    assert np.allclose(factors.T @ factors / 9, np.eye(2)) and abs((load.T @ load)[0, 1]) < 1e-6
    want = kernels.interactive(rest, use, np.zeros((9, 14, 0)), 2, "two-way", 1e-11, 100000)
    assert abs(loss[-1] - ((rest - want.y0)[use] ** 2).sum()) < 1e-4


@pytest.mark.parametrize("r", [0, 1])
def test_both_solvers_reach_the_same_likelihood(r):
    """With a factor some units are told apart wholly, so that the index grows on and no run converges; the likelihoods still meet."""
    y, x, index = binary(2, r=r)
    use = np.random.default_rng(3).random(y.shape) < 0.95
    found = {(s, e): kernels.probit(y, use, x, r, "two-way", 1e-9, 800, s, e) for s in ("svd", "qr") for e in (True, False)}
    like = {k: f.extra["loglik"] for k, f in found.items()}
    assert abs(like["qr", True] - like["svd", True]) < 1e-3 * abs(like["qr", True])
    for s in ("svd", "qr"):
        # the variance's step gets further in as many iterations, and needs fewer where there is an end
        assert like[s, True] >= like[s, False] - 1e-5 and (r or found[s, True].n_iter < found[s, False].n_iter)
    assert abs(found["qr", True].beta[0] - found["svd", True].beta[0]) < 0.02 and 0.6 < found["qr", True].beta[0] < 1.2
    clipped = np.clip(found["qr", True].extra["index"], -5, 5)
    assert np.corrcoef(clipped.ravel(), index.ravel())[0, 1] > 0.8


def test_marginal_effect_is_the_mean_slope_of_the_probability():
    y, x, _ = binary(4, r=0)
    got = kernels.probit(y, np.ones_like(y, bool), x, 0, "two-way", 1e-9, 5000, "qr")
    step = 1e-5
    slope = (stats.norm_cdf(got.extra["index"] + step * got.beta[0]) - got.y0).mean() / step
    assert abs(slope - got.extra["marginal"][0]) < 1e-4


def table(spark, y, x):
    t, n = y.shape
    rows = [(i, k + 1, float(y[k, i]), int(i < n // 4 and k >= t - 5), float(x[k, i, 0])) for i in range(n) for k in range(t)]
    return spark.createDataFrame(rows, "id long, time int, y double, d int, a double")


def test_rank_by_likelihood_and_intervals_of_marginal_effects(spark):
    y, x, _ = binary(5, t=40, r=1, strength=1.0)  # enough hidden cells for the likelihoods to differ by more than chance
    spec = PanelSpec(y="y", d="d", unit="id", time="time", x=("a",))
    df = table(spark, y, x)
    got = fit(df, spec, FitOptions(method="probit", r=(0, 2), min_t0=5, probit_solver="qr", tol=1e-6, max_iter=500, cv_method="all_units", cv_rule="min"), folds=6)
    assert got.scalars["r_cv"] == 1
    fixed = fit(df, spec, FitOptions(method="probit", r=0, min_t0=5, tol=1e-6, max_iter=500), se=True, nboots=20)
    row = fixed.intervals().where("kind = 'marginal'").first()
    assert abs(row["value"] - fixed.scalars["marginal_a"]) < 1e-12 and 0 < row["se"] < 0.1 and row["ci_low"] < row["value"] < row["ci_high"] and row["n_reps"] == 20
    scores = cv.evaluate(jobs.dense(got.cells, ("x1",)), [{"method": "probit", "r": r} for r in (0, 1)], spark, {"force": "two-way", "tol": 1e-3, "max_iter": 300}, 3, "all_units")
    by = {r["candidate"]: r["mean"] for r in cv.aggregate(scores, "unlikelihood").collect()}
    assert 0 < by[1] < by[0]
