"""Clustered errors of the two-way comparator and effects of switching by horizon, by hand."""

import numpy as np

from tessera.operators import did, panel
from tessera.plans.spec import FitOptions, PanelSpec

N, T = 24, 10


def cells(spark, seed=0, reversals=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(N):
        start, up = (4 + i % 3 if i < 12 else None), (i % 5 == 0)
        for t in range(1, T + 1):
            if rng.random() < 0.06:
                continue
            d = int(start is not None and t >= start and not (reversals and i % 4 == 1 and t >= 8))
            if reversals and i >= 18:  # treated from the start; some leave
                d = int(not (up and t >= 6))
            rows.append((i, t, float(rng.normal() + i + 0.3 * t + 2 * d), d, float(rng.normal()), i % 8))
    df = spark.createDataFrame(rows, "id long, time int, y double, d int, a double, c int")
    spec = PanelSpec(y="y", d="d", unit="id", time="time", x=("a",), cluster="c")
    return rows, panel.prepare(df, spec, FitOptions(min_t0=0))


def test_clustered_errors(spark):
    rows, prepared = cells(spark)
    used = {i for i in range(N) if min(r[1] for r in rows if r[0] == i) < min([r[1] for r in rows if r[0] == i and r[3]], default=99)}
    rows = [r for r in rows if r[0] in used]
    first = {i: min([r[1] for r in rows if r[0] == i and r[3]], default=99) for i in used}
    design = np.zeros((len(rows), 2 + N + T))
    for k, (i, t, _, _, a, _) in enumerate(rows):
        design[k, 0], design[k, 1], design[k, 2 + i], design[k, 1 + N + t] = t >= first[i], a, 1, 1
    y = np.array([r[2] for r in rows])
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    free = design[:, 0] - design[:, 1:] @ np.linalg.lstsq(design[:, 1:], design[:, 0], rcond=None)[0]
    for cluster, key in (("unit", 0), ("cl", 5)):
        got = did.twfe_clustered(prepared, ("x1",), cluster=cluster).first()
        groups = np.array([r[key] for r in rows])
        score = np.array([(free * (y - design @ b))[groups == g].sum() for g in np.unique(groups)])
        g, n = len(score), len(rows)
        se = np.sqrt((score**2).sum() * (n - 1) / (n - 2 - T) * g / (g - 1)) / (free**2).sum()
        assert abs(got["att"] - b[0]) < 1e-8 and abs(got["se"] - se) < 1e-8 and got["n_clusters"] == g and got["n_cells"] == n
        assert abs(got["ci_high"] - got["ci_low"] - 2 * 1.959963984540054 * se) < 1e-8


def test_switcher_effects(spark):
    rows, prepared = cells(spark, 3, reversals=True)
    y = {(r[0], r[1]): r[2] for r in rows}
    d = {(r[0], r[1]): r[3] for r in rows}
    start = {i: d[i, min(t for j, t in d if j == i)] for i in range(N)}
    switch = {i: min([t for j, t in d if j == i and d[j, t] != start[i]], default=99) for i in range(N)}

    def effect(k):
        sums, n, ell = 0.0, 0, abs(k)
        for i in range(N):
            base, at = switch[i] - 1, switch[i] - 1 + k
            if switch[i] == 99 or (i, base) not in y or (i, at) not in y or (k < 0 and (i, base + ell) not in y):
                continue
            controls = [j for j in range(N) if start[j] == start[i] and switch[j] > base + ell and (j, base) in y and (j, at) in y]
            if controls:
                sums += (1 if start[i] == 0 else -1) * (y[i, at] - y[i, base] - np.mean([y[j, at] - y[j, base] for j in controls]))
                n += 1
        return sums / n, n

    got = {r["horizon"]: (r["effect"], r["n_switchers"]) for r in did.switcher_effects(prepared, 3, 2).collect()}
    assert set(got) == {1, 2, 3, -1, -2}
    for k, (value, n) in got.items():
        want = effect(k)
        assert n == want[1] and abs(value - want[0]) < 1e-9
    assert any(start.values()) and all(abs(got[k][0] - 2) < 1.5 for k in (1, 2, 3))
