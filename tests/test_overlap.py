"""Loading overlap: the convex hull of the controls' loadings against all half-planes."""

import itertools

import numpy as np

from tessera.plans import plotdata
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec
from tessera.sources import simulate


def outside_some_half_plane(points, p):
    """Whether a line through two of the points has all of them on one side and p strictly on the other."""
    for a, b in itertools.permutations(points, 2):
        side = lambda q, a=a, b=b: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
        if np.hypot(*(b - a)) > 0 and all(side(q) >= -1e-12 for q in points) and side(p) < -1e-9:
            return True
    return False


def test_hull_against_half_planes():
    rng = np.random.default_rng(0)
    for n in (3, 4, 7, 15):
        for _ in range(10):
            points = np.round(rng.normal(size=(n, 2)), 1)
            corners = plotdata.hull(points)
            asked = np.concatenate([np.round(rng.normal(size=(20, 2)), 1), points])
            if len(corners) > 2:
                assert plotdata.within(corners, asked).tolist() == [not outside_some_half_plane(points, p) for p in asked]
            assert plotdata.within(corners, points).all()
    line = np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [1.0, 1.0]])
    assert plotdata.hull(line).tolist() == [[0, 0], [2, 2]]
    assert plotdata.within(plotdata.hull(line), np.array([[1.5, 1.5], [1.0, 1.2], [3.0, 3.0]])).tolist() == [True, False, False]
    assert plotdata.within(plotdata.hull(np.array([[1.0, 2.0]])), np.array([[1.0, 2.0], [1.0, 2.1]])).tolist() == [True, False]


def test_overlap_of_a_fit(spark):
    df = simulate.simulated(spark, n=40, t=20, n_treated=12, onset=13, tau=2.0, factors=2, noise=0.3, seed=11)
    spec = PanelSpec(y="y", d="d", unit="id", time="time")
    got = fit(df, spec, FitOptions(method="ife", r=2, min_t0=1))
    rows = plotdata.plot_data(got, "loading_overlap").collect()
    control = np.array([(r["l1"], r["l2"]) for r in rows if not r["ever"]])
    assert len(rows) == 40 and all(bool(r["inside"]) == (not outside_some_half_plane(control, np.array([r["l1"], r["l2"]]))) for r in rows)
    one = plotdata.plot_data(fit(df, spec, FitOptions(method="ife", r=1, min_t0=1)), "loading_overlap").collect()
    span = [r["l1"] for r in one if not r["ever"]]
    assert all(r["l2"] is None and bool(r["inside"]) == (min(span) <= r["l1"] <= max(span)) for r in one)
