"""Panels with missing cells, by brute force: effects from means of cells, and the closed jackknife where controls have gaps."""

from math import log, sqrt
from statistics import mean, stdev

import pytest

from tessera.operators import did, panel
from tessera.plans import estimands, jobs, leave_one_out
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec

SPEC = PanelSpec(y="y", d="d", unit="unit", time="time")


def rows_with_gaps(n=30, periods=8):
    """Every third unit is treated from period 4 or 5 on; a few cells are missing, among them one of a control in the last period."""
    gone = {(1, 8), (4, 6), (2, 8), (3, 2), (10, 3)}
    out = []
    for i in range(n):
        start = 4 + i % 2 if i % 3 == 1 else None
        out += [(i, t, ((i * 37 + t * 91 + i * t * 13) % 101) / 7 + i, int(start is not None and t >= start)) for t in range(1, periods + 1) if (i, t) not in gone]
    return out


def prepared(spark, rows):
    return panel.prepare(spark.createDataFrame(rows, "unit long, time int, y double, d int"), SPEC, FitOptions(min_t0=0))


def first_of(rows):
    return {i: min((t for u, t, _, d in rows if u == i and d), default=None) for i in {r[0] for r in rows}}


def effects_of_means(rows, control, universal=False):
    y, first = {(i, t): v for i, t, v, _ in rows}, first_of(rows)
    out = {}
    for c in {f for f in first.values() if f}:
        for t in range(1, 9):
            ref = c - 1 if t >= c or universal else t - 1
            outside = [i for i, f in first.items() if f is None or (control == "notyet" and f > max(t, ref) and f != c)]
            cell = lambda units, at: [y[i, at] for i in units if (i, at) in y]
            mine = [i for i, f in first.items() if f == c]
            if ref >= 1:
                out[c, t] = (mean(cell(mine, t)) - mean(cell(mine, ref)) - mean(cell(outside, t)) + mean(cell(outside, ref)), len(cell(mine, t)))
    return out


@pytest.mark.parametrize("control", ["never", "notyet"])
def test_group_time_of_means(spark, control):
    rows = rows_with_gaps()
    got = {(r["cohort"], r["time_ix"]): (r["att"], r["n_units"]) for r in did.group_time_of_means(prepared(spark, rows), control).collect()}
    want = effects_of_means(rows, control)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_interaction_weighted_of_means(spark):
    rows = rows_with_gaps()
    want = {}
    for (c, t), (att, n) in effects_of_means(rows, "never", universal=True).items():
        s, m = want.get(t - c + 1, (0.0, 0))
        want[t - c + 1] = s + att * n, m + n
    got = {r["event_time"]: (r["att"] * r["n_units"], r["n_units"]) for r in did.interaction_weighted(prepared(spark, rows), means=True).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def lonely(rows):
    """Period 2 is left with a single control (unit 0), so that leaving it out takes the period's level away."""
    return [r for r in rows if r[1] != 2 or r[0] % 3 == 1 or r[0] == 0]


def closed_form(rows):
    """{(unit, time): (event time, d, y, effect)} of the treated units: the mean of the controls observed in a period, and the unit's distance to it."""
    first = first_of(rows)
    level = {t: mean(y) for t in range(1, 9) if (y := [v for i, at, v, _ in rows if at == t and first[i] is None])}
    out = {}
    for i in (i for i, f in first.items() if f):
        rest = {t: v - level[t] for u, t, v, _ in rows if u == i and t in level}
        own = mean(v for t, v in rest.items() if t < first[i])
        out |= {(i, t): (t - first[i] + 1, int(t >= first[i]), v + level[t], v - own) for t, v in rest.items()}
    return out


@pytest.mark.parametrize("change", [lambda rows: rows, lonely], ids=["gaps", "a control alone"])
def test_closed_jackknife_with_gaps(spark, monkeypatch, change):
    rows = [(i, t, y + 40, d) for i, t, y, d in change(rows_with_gaps())]
    monkeypatch.setattr(jobs, "dense", lambda *a: pytest.fail("the panel was collected"))
    monkeypatch.setattr(leave_one_out, "AT_ONCE", 3)
    df = spark.createDataFrame(rows, "unit long, time int, y double, d int")
    got = fit(df, SPEC, FitOptions(sample="nevertreated", control_means=True), se=True, vartype="jackknife", keep_surface=True)
    without = {i: closed_form([r for r in rows if r[0] != i]) for i in {r[0] for r in rows}}
    reps = {(r["left_out"], r["kind"], r["at"]): (r["value"], r["n_cells"]) for r in got.replicates.where("kind in ('overall', 'event')").collect()}
    want = {}
    for i, cells in without.items():
        want[i, "overall", 0.0] = [c[3] for c in cells.values() if c[1]]
        for e in {c[0] for c in cells.values()}:
            want[i, "event", float(e)] = [c[3] for c in cells.values() if c[0] == e]
    assert reps.keys() == want.keys()
    assert all(reps[k] == (pytest.approx(mean(v)), len(v)) for k, v in want.items())
    # the relation of cells and replicates, and an estimand that isn't linear in the effects
    surface = estimands.imputed_outcomes(got, "treated and event_time = 2", replicates=True).collect()
    two = sorted(c[3] for cells in without.values() for c in cells.values() if c[0] == 2)
    assert sorted(r["eff"] for r in surface) == pytest.approx(two)
    logs = {r["at"]: r for r in estimands.estimand_intervals(got, "log_att").collect()}
    shares = {r["at"]: r for r in estimands.estimand_intervals(got, "aptt").collect()}
    for e in range(1, 5):
        v = [mean(log(c[2]) - log(c[2] - c[3]) for c in cells.values() if c[0] == e) for cells in without.values()]
        assert logs[e]["se"] == pytest.approx(stdev(v) * (len(v) - 1) / sqrt(len(v)))
        v = [sum(c[3] for c in cells.values() if c[0] == e) / sum(c[2] - c[3] for c in cells.values() if c[0] == e) for cells in without.values()]
        assert shares[e]["se"] == pytest.approx(stdev(v) * (len(v) - 1) / sqrt(len(v)))


def test_log_sums_in_blocks(spark):
    df = spark.createDataFrame([(i, t, y + 40, d) for i, t, y, d in rows_with_gaps()], "unit long, time int, y double, d int")
    cells = fit(df, SPEC, FitOptions(sample="nevertreated", control_means=True)).cells
    rows = cells.where("d = 1 and eff is not null").selectExpr("unit", "time_ix", "cast(t_on as double) as at", "y", "y0")
    one, many = ({(r["job_id"], r["at"]): (r["s"], r["n"]) for r in leave_one_out.log_sums(cells, rows, block).collect()} for block in (2048, 4))
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(one[k]) for k in one)


@pytest.mark.parametrize("change", [lambda rows: rows, lonely], ids=["gaps", "a control alone"])
def test_cell_replicates_in_blocks(spark, change):
    """Blocks give the rows that one block gives, each pair of a cell and another unit once, and the plan shuffles no pairs."""
    df = spark.createDataFrame([(i, t, y + 40, d) for i, t, y, d in change(rows_with_gaps())], "unit long, time int, y double, d int")
    cells = fit(df, SPEC, FitOptions(sample="nevertreated", control_means=True)).cells
    rows = cells.where("t_on = 2 and eff is not null").select("unit", "time", "time_ix", "eff", "g")
    one, many = (leave_one_out.cell_replicates(cells, rows, block) for block in (2048, 4))
    a, b = ({(r["unit"], r["time_ix"], r["left_out"]): r["eff"] for r in x.collect()} for x in (one, many))
    assert len(a) == rows.count() * 29 == many.count() and a.keys() == b.keys() and all(b[k] == pytest.approx(a[k]) for k in a)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(reps" in plan and "Join" not in plan[: plan.index("Generate explode(reps")]
