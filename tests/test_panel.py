import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import additive, did, effects, event_time, panel
from tessera.plans import cv, diagnostics, estimands, inference, jobs, plotdata
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec, formula
from tessera.functions import kernels, stats
from tessera.sources import simulate

SPEC = PanelSpec(y="y", d="d", unit="id", time="time")


def cells_of(spark, rows):
    return spark.createDataFrame([(u, t, d) for u, path in enumerate(rows) for t, d in enumerate(path)], "unit int, time_ix int, d int")


N = None
TRUTH = [
    ([0, 0, 1, 1], [-1, 0, 1, 2], [N] * 4), ([1, 1, 0, 0], [N] * 4, [-1, 0, 1, 2]), ([0, 1, 0, 0, 1, 1], [0, 1, -1, 0, 1, 2], [N, 0, 1, 2, N, N]),
    ([0, 0, 0], [N] * 3, [N] * 3), ([1, 1, 1], [N] * 3, [N] * 3), ([N, 0, N, 1], [N, -1, 0, 1], [N] * 4),
]


def test_event_time_truth_table(spark):
    cells = cells_of(spark, [d for d, _, _ in TRUTH])
    out = event_time.with_event_time(event_time.with_event_time(cells, to="t_on"), to="t_off", off=True)
    got = {}
    for r in out.orderBy("unit", "time_ix").collect():
        got.setdefault(r["unit"], ([], []))[0].append(r["t_on"])
        got[r["unit"]][1].append(r["t_off"])
    assert [got[i] for i in range(len(TRUTH))] == [(a, b) for _, a, b in TRUTH]


def test_formula_and_options():
    assert formula("Y ~ D + X1 + X2", "id", "t") == PanelSpec(y="Y", d="D", unit="id", time="t", x=("X1", "X2"))
    for bad in ("Y", "Y ~ ", "Y ~ D + X1*X2"):
        with pytest.raises(ValueError):
            formula(bad, "id", "t")
    for bad in ({"placebo": (-1, 0), "carryover": (1, 2)}, {"method": "mc", "sample": "nevertreated"}, {"balance": (1, 2)}, {"force": "x"}):
        with pytest.raises(ValueError):
            FitOptions(**bad)


def test_unsound_panels(spark):
    rows = [(1, 1, 1.0, 0), (1, 1, 2.0, 1), (2, 1, 1.0, 0)]
    with pytest.raises(ValueError, match="duplicate_key"):
        panel.check(spark.createDataFrame(rows, "id int, time int, y double, d int"), SPEC)
    with pytest.raises(ValueError, match="treatment_constant"):
        panel.check(spark.createDataFrame([(1, 1, 1.0, 0)], "id int, time int, y double, d int"), SPEC)


def test_exact_fit_is_least_squares(spark):
    data = simulate.frame(n=20, t=12, n_treated=6, onset=8, missing=0.1, beta=1.5, seed=3)
    df = simulate.simulated(spark, n=20, t=12, n_treated=6, onset=8, missing=0.1, beta=1.5, seed=3)
    got = fit(df, PanelSpec(y="y", d="d", unit="id", time="time", x=("x1",)), FitOptions(method="fe"))
    use = data[(data.d == 0) & data.y.notna()]
    design = np.column_stack([use.x1, *(use.id == i for i in range(1, 21)), *(use.time == t for t in range(2, 13))]).astype(float)
    coef = np.linalg.lstsq(design, use.y.to_numpy(), rcond=None)[0]
    assert abs(got.scalars["beta_x1"] - coef[0]) < 1e-8
    full = np.column_stack([data.x1, *(data.id == i for i in range(1, 21)), *(data.time == t for t in range(2, 13))]).astype(float) @ coef
    want = {(i, t): v for i, t, v in zip(data.id, data.time, full, strict=True)}
    for r in got.cells.collect():
        assert abs(r["y0"] - want[r["unit"], r["time"]]) < 1e-7


def test_unconnected_panel_raises(spark):
    rows = [(u, t, float(t), int(u == 1 and t == 4)) for u in (1, 2) for t in (1, 2, 3, 4)] + [(u, t, 1.0, 0) for u in (3, 4) for t in (11, 12)]
    with pytest.raises(ValueError, match="connected"):
        fit(spark.createDataFrame(rows, "id int, time int, y double, d int"), SPEC)


def test_closed_form_equals_kernel(spark):
    df = simulate.simulated(spark, n=24, t=14, n_treated=8, staggered=True, seed=5)
    cells = panel.prepare(df, SPEC, FitOptions(sample="nevertreated"))
    closed = {(r["unit"], r["time_ix"]): r["y0"] for r in additive.never_treated(cells).collect()}
    p = jobs.dense(cells)
    y0 = jobs.fit_dense(p, "fe", sample="nevertreated").y0
    assert all(abs(closed[u, t + 1] - y0[t, i]) < 1e-8 for i, u in enumerate(p.units) if p.ever[i] for t in range(14))


@pytest.mark.parametrize("method, sample", [("ife", "notyettreated"), ("gsc", "nevertreated"), ("mc", "notyettreated"), ("cfe", "notyettreated")])
def test_factor_models_recover_the_effect(spark, method, sample):
    df = simulate.simulated(spark, n=60, t=24, n_treated=15, onset=16, tau=3.0, factors=1, noise=0.3, seed=7)
    options = FitOptions(method=method, sample=sample, r=1, lam=0.002 if method == "mc" else None)
    att = fit(df, SPEC, options).overall().first()["att_avg"]
    assert abs(att - 3.0) < (1.0 if method == "mc" else 0.4)


def test_interactive_without_factors_is_least_squares_and_balanced_pca():
    rng = np.random.default_rng(0)
    y, use = rng.normal(size=(15, 20)), rng.random((15, 20)) < 0.9
    x = np.zeros((15, 20, 0))
    a = kernels.interactive(y, use, x, 0, "two-way", 1e-8, 500)
    b = kernels.interactive(y, use, x, 0, "two-way", 1e-10, 5000, lam=1e9)
    assert np.abs(a.y0 - b.y0).max() < 1e-5  # a penalty that large leaves additive effects only
    f, load = kernels.principal(y, 3)
    u, s, v = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(f @ load.T, (u[:, :3] * s[:3]) @ v[:3]) and np.allclose(f.T @ f / 15, np.eye(3))


def test_bounded_weights_lie_on_the_simplex():
    rng = np.random.default_rng(1)
    f, load = rng.normal(size=(20, 2)), rng.normal(size=(15, 2))
    u = f @ np.array([0.3, 0.5]) + rng.normal(0, 0.1, 20)
    w = kernels.bounded_weights(u, f, load, 100.0)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and ((u - f @ load.T @ w) ** 2).mean() < 0.05
    assert np.abs(kernels.bounded_weights(u, f, load, 1e-6) - 1 / 15).max() < 1e-3


def test_jackknife_and_bootstrap(spark):
    df = simulate.simulated(spark, n=24, t=12, n_treated=8, onset=8, tau=2.0, seed=2)
    got = fit(df, SPEC, FitOptions(), se=True, vartype="jackknife")
    p = got.panel
    values = [jobs.event_table(q := p.take(np.delete(np.arange(24), i)), q.y - jobs.fit_dense(q).y0)[0][2] for i in range(24)]
    row = got.intervals().where("kind = 'overall'").first()
    assert abs(row["se"] - np.std(values, ddof=1) * 23 / np.sqrt(24)) < 1e-8
    boot = fit(df, SPEC, FitOptions(), se=True, nboots=60)
    for method in ("normal", "basic", "percentile"):
        r = boot.intervals(method=method).where("kind = 'overall'").first()
        assert r["ci_low"] < 2.0 < r["ci_high"] and r["n_reps"] == 60
    assert 0.3 < boot.intervals().where("kind = 'overall'").first()["se"] / row["se"] < 3
    tests = diagnostics.pretrend(boot)
    assert 0 <= tests["f_p"] <= 1 and 0 <= tests["tost_p"] <= 1
    sens = {r["bound"]: r for r in diagnostics.sensitivity(boot).collect()}
    assert sens[0.0]["ci_low"] > sens[1.0]["ci_low"] and sens[0.0]["ci_high"] < sens[1.0]["ci_high"]
    assert estimands.with_uncertainty(boot).count() > 5 and estimands.cumulative_with_uncertainty(boot, (1, 3)).count() == 3
    assert plotdata.plot_data(boot, "equiv").where("event_time > 0").count() == 0
    assert plotdata.plot_data(boot, "calendar").count() == 4
    assert plotdata.event_study(plotdata.plot_data(boot, "gap"), estimate="value").count() == 12


def test_parametric_placebo_permutation_and_loo(spark):
    df = simulate.simulated(spark, n=24, t=14, n_treated=6, onset=9, tau=3.0, noise=0.5, seed=4)
    got = fit(df, SPEC, FitOptions(method="fe", sample="nevertreated"), se=True, vartype="parametric", nboots=20)
    r = got.intervals().where("kind = 'overall'").first()
    assert r["n_reps"] == 20 and abs(r["value"] - 3.0) < 1
    placebo = fit(df, SPEC, FitOptions(placebo=(-1, 0)), se=True, nboots=30)
    test = diagnostics.window_test(placebo)
    assert abs(test["att"]) < 1 and 0 <= test["p_value"] <= 1
    p = placebo.panel
    assert inference.permutation_test(p, FitOptions(), spark, 30, units=True).first()["p_value"] < 0.2
    assert diagnostics.leave_one_period_out(got, nboots=4).count() >= 5


def test_rank_is_chosen_and_scores_agree(spark):
    df = simulate.simulated(spark, n=50, t=25, n_treated=12, onset=17, tau=2.0, factors=2, noise=0.3, seed=11)
    got = fit(df, SPEC, FitOptions(method="ife", r=(0, 3)), folds=4)
    assert got.scalars["r_cv"] == 2
    p = got.panel
    scores = cv.compare(p, {"fe": {"method": "fe"}, "ife": {"method": "ife", "r": 2}}, spark, folds=3)
    by = {(r["model"], r["score"]): r["value"] for r in scores.collect()}
    assert by["ife", "mspe"] < by["fe", "mspe"] and all(by[m, "mspe"] >= 0 for m in ("fe", "ife"))
    hidden, scored = cv.rolling_mask(p, 3)
    assert (scored <= hidden).all() and (hidden <= p.use).all() and scored.any()


def test_estimands(spark):
    df = simulate.simulated(spark, n=30, t=20, n_treated=10, staggered=True, positive=True, seed=1)
    got = fit(df, SPEC, FitOptions())
    surface = estimands.imputed_outcomes(got)
    rows = [r for r in surface.collect() if r["treated"] and r["event_time"] is not None]
    att = estimands.estimand(got, "att", "overall").first()
    assert abs(att["att"] - np.mean([r["eff"] for r in rows])) < 1e-9
    log = {r["event_time"]: r["log_att"] for r in estimands.estimand(got, "log_att").collect()}
    at1 = [np.log(r["y"]) - np.log(r["y0"]) for r in rows if r["event_time"] == 1 and r["y0"] > 0]
    assert abs(log[1] - np.mean(at1)) < 1e-9
    assert estimands.estimand(got, "att", "event_time", window=(1, 3)).count() == 3
    assert estimands.estimand(got, "att_cumu", "overall", window=(1, 3)).first()["event_time"] == 3
    assert estimands.estimand(got, "att", "overall", cells="~ event_time > 2").first()["n_cells"] < att["n_cells"]
    with pytest.raises(ValueError):
        estimands.estimand(got, "aptt", "overall")


def test_did_recovers(spark):
    df = simulate.simulated(spark, n=80, t=16, n_treated=30, onset=9, tau=2.0, noise=0.3, seed=6)
    cells = panel.prepare(df, SPEC, FitOptions())
    for value in (did.twfe(cells), did.stacked(cells), did.aggregated(did.group_time(cells, "never"), "simple"), did.aggregated(did.group_time(cells, "notyet"), "simple")):
        assert abs(value.first()["att"] - 2.0) < 0.4
    assert abs(did.switchers(cells).first()["did_m"] - 2.0) < 0.6


def test_probit_and_multilevel_kernels():
    rng = np.random.default_rng(3)
    latent = rng.normal(size=(1, 40)) + 0.8 * rng.normal(size=(30, 1))
    y = (latent + rng.normal(size=(30, 40)) > 0).astype(float)
    got = kernels.probit(y, np.ones_like(y, bool), np.zeros((30, 40, 0)), 0, "two-way", 1e-7, 3000)
    assert abs(got.y0.mean() - y.mean()) < 0.03 and np.corrcoef(got.extra["index"].ravel(), latent.ravel())[0, 1] > 0.8
    level = np.add.outer(np.arange(30) // 10, np.arange(40) % 4 * 3)
    z = np.column_stack([np.ones(40), rng.normal(size=40)])
    truth = rng.normal(size=12)[level] + np.outer(np.arange(30) / 10, z[:, 1]) + rng.normal(size=(1, 40))
    out = kernels.complex_effects(truth, rng.random(truth.shape) < 0.9, np.zeros((30, 40, 0)), 0, "two-way", 1e-9, 4000, [level], z, np.arange(30))
    assert np.abs(out.y0 - truth).max() < 1e-2


def test_distributions():
    assert abs(stats.t_cdf(2.0, 10) - 0.963306) < 1e-5 and abs(stats.f_cdf(3.0, 2, 10) - 0.904632) < 1e-5
    assert abs(stats.chi2_cdf(3.84, 1) - 0.949957) < 1e-5 and abs(stats.noncentral_f_cdf(2.0, 3, 20, 0.0) - stats.f_cdf(2.0, 3, 20)) < 1e-10
    assert stats.noncentral_f_cdf(2.0, 3, 20, 5.0) < stats.f_cdf(2.0, 3, 20) and abs(stats.t_ppf(0.975, 10) - 2.228139) < 1e-5
    t = np.linspace(0, 1, 30)
    assert np.abs(stats.loess(t, 1 + 2 * t + t**2) - (1 + 2 * t + t**2)).max() < 1e-8
    basis = stats.spline_basis(t, "bspline", 3, 6)
    assert basis.shape == (30, 6) and (basis >= -1e-12).all() and stats.spline_basis(t, "cubic").shape == (30, 3)


def test_regression_trends_and_implied_weights(spark):
    from tessera.plans import regression

    df = simulate.simulated(spark, n=40, t=20, n_treated=10, onset=14, tau=0.0, beta=1.5, factors=1, noise=0.3, seed=8)
    got = {r["term"]: r for r in regression.interactive_regression(df, "y", ("x1",), "id", "time", r=1, nboots=20).collect()}
    assert got["x1"]["ci_low"] < 1.5 < got["x1"]["ci_high"] and got["sigma2"]["estimate"] > 0
    trended, names = regression.with_trend(df, "time", "quadratic")
    cfe = fit(trended, PanelSpec(y="y", d="d", unit="id", time="time", q=names), FitOptions(method="cfe", tol=1e-4, max_iter=500))
    assert np.isfinite(cfe.overall().first()["att_avg"])
    gsc = fit(df, SPEC, FitOptions(method="gsc", r=1))
    weights = regression.implied_weights(gsc)
    assert weights.count() == 10 * 30
    load = {r["unit"]: np.array(r["loadings"]) for r in gsc.units.collect()}
    one = weights.where("unit = 1").collect()
    assert np.allclose(sum(r["weight"] * load[r["control"]] for r in one), load[1])


def test_did_resampling_agrees_with_the_plans(spark):
    from tessera.plans import did_inference

    df = simulate.simulated(spark, n=40, t=12, n_treated=16, staggered=True, tau=2.0, noise=0.3, seed=9)
    cells = panel.prepare(df, SPEC, FitOptions()).cache()
    p = jobs.dense(cells)
    plans = {
        "twfe": did.twfe(cells), "st": did.stacked(cells), "cs_never": did.aggregated(did.group_time(cells, "never"), "simple"), "cs_notyet": did.aggregated(did.group_time(cells, "notyet"), "simple")}
    for method, plan in plans.items():
        assert abs(did_inference.estimate(p, method)[0][2] - plan.first()["att"]) < 1e-8
    iw = {r["event_time"]: r["att"] for r in did.interaction_weighted(cells).collect()}
    assert all(abs(iw[int(at)] - v) < 1e-8 for kind, at, v, _ in did_inference.estimate(p, "iw") if kind == "event")
    row = did_inference.intervals(cells, "cs_never", nboots=25).where("kind = 'overall'").first()
    assert abs(row["value"] - 2.0) < 0.3 and row["ci_low"] < row["value"] < row["ci_high"] and row["n_reps"] == 25


def test_multilevel_never_treated_kernel():
    rng = np.random.default_rng(4)
    t, n = 20, 30
    control = np.arange(n) >= 8
    shared = np.add.outer(np.arange(t) // 5, np.zeros(n, int))
    z = np.column_stack([np.ones(n), rng.normal(size=n)])
    truth = rng.normal(size=(t, 1)) + rng.normal(size=(1, n)) + np.array([0.5, -1, 2, 0])[shared] + np.outer(np.arange(t) / 5, z[:, 1])
    d = np.zeros((t, n), bool)
    d[14:, :8] = True
    got = kernels.complex_never_treated(truth + 5 * d, ~d, ~d, control, np.zeros((t, n, 0)), 0, "two-way", 1e-10, 5000, [shared], z, np.arange(t))
    assert np.abs(got.y0 - truth).max() < 1e-3


def test_event_study_is_least_squares(spark):
    data = simulate.frame(n=24, t=12, n_treated=8, staggered=True, missing=0.15, seed=4)
    df = simulate.simulated(spark, n=24, t=12, n_treated=8, staggered=True, missing=0.15, seed=4)
    cells = panel.prepare(df, SPEC, FitOptions(min_t0=0))
    got = {r["event_time"]: r["coef"] for r in did.twfe_event_study(cells).collect()}
    first = data[data.d == 1].groupby("id").time.min()
    data["at"] = data.time - data.id.map(first) + 1
    use = data[data.y.notna()]
    times = sorted(int(e) for e in use["at"].dropna().unique() if e != 0)
    assert sorted(got) == times
    design = np.column_stack([*(use["at"] == e for e in times), *(use.id == i for i in range(1, 25)), *(use.time == t for t in range(1, 13))]).astype(float)
    effects_of = lambda coef: design[:, : len(times)] @ coef
    coef = np.linalg.lstsq(design, use.y.to_numpy(), rcond=None)[0]
    mine = np.array([got[e] for e in times])
    rest = np.linalg.lstsq(design[:, len(times) :], use.y.to_numpy() - effects_of(mine), rcond=None)[0]
    assert abs(((use.y.to_numpy() - design @ coef) ** 2).sum() - ((use.y.to_numpy() - effects_of(mine) - design[:, len(times) :] @ rest) ** 2).sum()) < 1e-6


def test_probit_normalised_and_separate_weights(spark):
    data = simulate.frame(n=40, t=12, n_treated=12, onset=9, seed=1)
    rows = [(int(r.id), int(r.time), float(r.y > 0), int(r.d), float(1 + r.id % 3), float(r.time % 2)) for r in data.itertuples()]
    df = spark.createDataFrame(rows, "id int, time int, y double, d int, w double, wa double")
    got = fit(df, SPEC, FitOptions(method="probit", min_t0=3))
    y0 = [r["y0"] for r in got.cells.where("y0 is not null").collect()]
    assert y0 and all(0 <= v <= 1 for v in y0)
    with pytest.raises(ValueError, match="0 and 1"):
        fit(df.withColumn("y", F.col("y") * 2), SPEC, FitOptions(method="probit"))
    plain = simulate.simulated(spark, n=20, t=12, n_treated=6, onset=8, missing=0.1, seed=2)
    a, b = (sorted((r["event_time"], round(r["att"], 6)) for r in fit(plain, SPEC, FitOptions(method=m, r=1, tol=1e-9, normalize=n)).event().collect()) for m, n in (("fe", False), ("fe", True)))
    assert a == b
    spec = PanelSpec(y="y", d="d", unit="id", time="time", weight="w", agg_weight="wa")
    out = {r["event_time"]: r for r in fit(df, spec, FitOptions(min_t0=3)).event().collect()}
    assert out[2]["att_w"] is None or out[1]["att_w"] is None  # every other period weighs nothing


def test_selection_options(spark):
    df = simulate.simulated(spark, n=24, t=14, n_treated=8, onset=11, factors=1, seed=6)
    for method, rule in (("rolling", "min"), ("loo", "1se"), ("all_units", "1pct")):
        got = fit(df, SPEC, FitOptions(method="ife", r=(0, 2), tol=1e-3, cv_method=method, cv_rule=rule), folds=3)
        assert got.scalars["r_cv"] in (0, 1, 2)
    with pytest.raises(ValueError):
        FitOptions(cv_rule="best")


def test_occupancy_and_reversals_are_checked(spark):
    df = simulate.simulated(spark, n=12, t=10, n_treated=4, onset=6, seed=0)
    with pytest.raises(ValueError, match="empty_unit"):
        fit(df.where("not (id = 1 and d = 0)"), SPEC, FitOptions(min_t0=0))
    back = simulate.simulated(spark, n=12, t=12, n_treated=4, onset=4, reversals=True, seed=0)
    with pytest.raises(ValueError, match="doesn't end"):
        fit(back, SPEC, FitOptions(sample="nevertreated"), se=True, vartype="parametric", nboots=2)
