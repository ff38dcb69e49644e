"""Linear programmes and intervals under bounded violations of parallel trends, against enumeration and grids."""

import itertools

import numpy as np
import pytest

from tessera.functions import linear_programs, stats
from tessera.plans import diagnostics, plotdata, sensitivity
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec
from tessera.sources import simulate


def vertices(a, b):
    """All basic feasible points of a x = b, x >= 0."""
    m, n = a.shape
    for columns in map(list, itertools.combinations(range(n), m)):
        if abs(np.linalg.det(a[:, columns])) > 1e-9:
            x = np.linalg.solve(a[:, columns], b)
            if (x >= -1e-9).all():
                out = np.zeros(n)
                out[columns] = x
                yield out


def test_simplex_finds_the_best_vertex():
    rng = np.random.default_rng(0)
    for _ in range(150):
        m, n = int(rng.integers(1, 4)), int(rng.integers(4, 8))
        a, c = rng.normal(size=(m, n)), rng.random(n)
        b = a @ (rng.random(n) * (rng.random(n) < 0.6))
        got = linear_programs.minimise(c, a, b)
        assert abs(got.value - min(c @ x for x in vertices(a, b))) < 1e-7
        assert np.allclose(a @ got.x, b) and (got.x >= -1e-9).all() and abs(got.prices @ b - got.value) < 1e-7


def test_simplex_refuses_what_has_no_optimum():
    with pytest.raises(linear_programs.Infeasible):
        linear_programs.minimise(np.ones(2), np.array([[1.0, 1.0]]), np.array([-1.0]))
    with pytest.raises(linear_programs.Unbounded):
        linear_programs.minimise(np.array([-1.0, 0.0]), np.array([[1.0, -1.0]]), np.array([0.0]))


def synthetic(seed=0, n_pre=3, n_post=3):
    rng = np.random.default_rng(seed)
    n = n_pre + n_post
    root = rng.normal(size=(n, n)) * 0.1
    cov = root @ root.T + 0.01 * np.eye(n)
    value = rng.multivariate_normal(np.concatenate([np.zeros(n_pre), np.ones(n_post)]), cov)
    return sensitivity.Path(list(range(1 - n_pre, n_post + 1)), value, cov, np.arange(10, 10 + n))


def test_quantiles():
    assert abs(sensitivity.folded_quantile(0.0, 0.95) - stats.norm_ppf(0.975)) < 1e-9
    q = sensitivity.folded_quantile(1.3, 0.9)
    assert abs(stats.norm_cdf(q - 1.3) - stats.norm_cdf(-q - 1.3) - 0.9) < 1e-9
    draws = np.random.default_rng(0).normal(size=400000) * 2
    inside = draws[(draws > 1) & (draws < 5)]
    assert abs(sensitivity.truncated_quantile(0.9, 1.0, 5.0, 2.0) - np.quantile(inside, 0.9)) < 0.02
    assert 40 <= sensitivity.truncated_quantile(0.9, 40.0, 50.0, 1.0) < 40.1


@pytest.mark.parametrize("bound", [0.0, 0.05, 0.3])
def test_fixed_length_is_the_shortest(bound):
    """Three earlier periods leave one free weight: scan it. The bias of each estimator comes from the extreme paths."""
    p = synthetic(3)
    w = p.weights("overall")
    assert np.allclose(w, p.n_cells[3:] / p.n_cells[3:].sum())
    low, high = sensitivity.fixed_length(p, w, bound)
    n = len(p.at)
    paths = [np.linalg.lstsq(sensitivity._second_differences(n), np.array(signs), rcond=None)[0] for signs in itertools.product((-bound, bound), repeat=n - 2)]
    lengths = []
    for first in np.linspace(-20, 20, 4001):
        rest = np.linalg.solve(np.array([[1.0, 1.0], [1.0, 2.0]]), -np.array([w.sum() + first, w @ np.arange(3, n)]))
        c = np.concatenate([[first], rest, w])
        se, bias = np.sqrt(c @ p.cov @ c), max(abs(c @ d) for d in paths)
        lengths.append(2 * se * sensitivity.folded_quantile(bias / se, 0.95))
    assert high - low <= min(lengths) * 1.002
    # the estimator that extrapolates the last two periods' trend, with its own worst case, is one of them
    slope = w @ np.arange(1, 4)
    c = np.concatenate([[0.0, slope, -1 - slope], w])
    assert high - low <= 2 * (max(abs(c @ d) for d in paths) + stats.norm_ppf(0.975) * np.sqrt(c @ p.cov @ c)) + 1e-9


def test_conditional_statistic_by_enumeration():
    p = synthetic(5)
    w = p.weights("overall")
    for a, b in sensitivity.polyhedra(p, "relative", 0.5) + sensitivity.polyhedra(p, "smooth", 0.1):
        test = sensitivity.Inequalities(p, a, b, w, 0.95)
        equations = np.concatenate([test.free.T, test.scale[None, :]])
        duals = list(vertices(equations, np.append(np.zeros(test.free.shape[1]), 1.0)))
        for value in (-1.0, 0.5, 1.0, 3.0):
            y = test.y - test.slope * value
            eta, weights, basis = test.statistic(y)
            assert abs(eta - max(g @ y for g in duals)) < 1e-8
            sd2 = weights @ test.cov @ weights
            low, high = test.interval(y, weights, basis, eta, sd2)
            move = test.cov @ weights / sd2
            for x, same in ((low + 1e-6, True), (low - 1e-4, False), (high - 1e-6, True), (high + 1e-4, False)):
                if np.isfinite(x):
                    best = max(g @ (y + move * (x - eta)) for g in duals)
                    assert (best - x < 1e-7) == same


def test_intervals_cover_and_grow():
    hits, lengths = 0, []
    for seed in range(25):
        p = synthetic(seed)
        w = p.weights("overall")
        hits += any(not sensitivity.Inequalities(p, a, b, w, 0.95).rejects(1.0) for a, b in sensitivity.polyhedra(p, "relative", 1.0))
        low, high = sensitivity.fixed_length(p, w, 0.0)
        hits += low <= 1 <= high
    assert hits >= 42
    p = synthetic(1)
    for bound in (0.0, 0.1, 0.4):
        low, high = sensitivity.conditional(p, *sensitivity.polyhedra(p, "smooth", bound)[0], p.weights("2"))
        lengths.append(high - low)
    assert lengths == sorted(lengths) and lengths[0] > 0


def test_sensitivity_of_a_fit(spark):
    df = simulate.simulated(spark, n=30, t=12, n_treated=10, onset=8, tau=2.0, seed=2)
    got = fit(df, PanelSpec(y="y", d="d", unit="id", time="time"), FitOptions(sample="nevertreated"), se=True, vartype="jackknife")
    rows = {(r["restriction"], r["bound"]): r for r in diagnostics.sensitivity(got, "relative", (0.0, 0.5), pre=(-2, 0), post=(1, 3)).collect()}
    assert set(rows) == {("none", None), ("relative", 0.0), ("relative", 0.5)}
    assert rows["relative", 0.5]["ci_low"] <= rows["relative", 0.0]["ci_low"] < rows["relative", 0.0]["ci_high"] <= rows["relative", 0.5]["ci_high"]
    periods = plotdata.plot_data(got, "sens_es", restriction="smooth", bounds=(0.0, 0.1), pre=(-2, 0), post=(1, 3)).collect()
    assert sorted((r["restriction"], r["bound"] or 0.0, r["target"]) for r in periods) == sorted((k, b, t) for k, b in (("none", 0.0), ("smooth", 0.0), ("smooth", 0.1)) for t in "123")
    with pytest.raises(ValueError, match="two consecutive"):
        diagnostics.sensitivity(got, pre=(0, 0))
    with pytest.raises(ValueError, match="relative"):
        diagnostics.sensitivity(got, "relative", method="fixed", pre=(-2, 0))
