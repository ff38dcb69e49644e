"""The replicates' surface: its aggregates are the replicates' estimates, on every route and filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import estimands, inference, jobs
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec
from tessera.sources import simulate, stored

SPEC = PanelSpec(y="y", d="d", unit="id", time="time")


def simulated(spark, seed=2):
    return simulate.simulated(spark, n=24, t=12, n_treated=8, onset=8, tau=2.0, seed=seed)


def as_dict(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows.collect()}


@pytest.mark.parametrize("options, vartype", [({"sample": "nevertreated"}, "jackknife"), ({}, "jackknife"), ({}, "bootstrap"), ({"sample": "nevertreated", "method": "gsc", "r": 1}, "parametric")])
def test_surface_gives_the_replicates_estimates(spark, options, vartype):
    got = fit(simulated(spark), SPEC, FitOptions(**options), se=True, vartype=vartype, nboots=8, keep_surface=True)
    rows = estimands.imputed_outcomes(got, "event_time is not null", replicates=True).cache()
    n = F.col("n_drawn")
    want = as_dict(got.replicates.where("error is null"), "job_id", "kind", "at")
    for kind, at, some in (("overall", F.lit(0.0), rows.where("treated")), ("event", F.col("event_time").cast("double"), rows)):
        per = some.groupBy("job_id", at.alias("at")).agg((F.sum(n * F.col("eff")) / F.sum(n)).alias("v"), F.sum(n).alias("n")).collect()
        assert len(per) == sum(k[1] == kind for k in want)
        for r in per:
            w = want[r["job_id"], kind, r["at"]]
            assert abs(r["v"] - w["value"]) < 1e-6 and r["n"] == w["n_cells"]
    rows.unpersist()


def test_intervals_without_a_filter_are_the_fits_own(spark):
    got = fit(simulated(spark), SPEC, FitOptions(), se=True, nboots=30, keep_surface=True)
    own = as_dict(got.intervals(method="basic").where("kind = 'event'"), "at")
    for r in estimands.estimand_intervals(got).collect():
        w = own[(r["at"],)]
        assert all(abs(r[c] - w[c]) < 1e-6 for c in ("value", "se", "ci_low", "ci_high", "p_value")) and r["n_reps"] == w["n_reps"]
    total = estimands.estimand_intervals(got, "att", "overall", method="percentile").first()
    w = got.intervals(method="percentile").where("kind = 'overall'").first()
    assert all(abs(total[c] - w[c]) < 1e-6 for c in ("value", "se", "ci_low", "ci_high"))


def test_filters_windows_and_kinds(spark):
    df = simulated(spark).withColumn("y", F.col("y") + 30)
    got = fit(df, SPEC, FitOptions(sample="nevertreated"), se=True, vartype="jackknife", keep_surface=True)
    # refit without each unit, by hand
    p = jobs.dense(got.cells)
    effs = {}
    for i, u in enumerate(p.units):
        q = p.take(np.delete(np.arange(24), i))
        effs[u] = (q, q.y - jobs.fit_dense(q, sample="nevertreated").y0)

    def jackknife(value):
        v = np.array([x for x in (value(q, e) for q, e in effs.values()) if x is not None])
        return v.std(ddof=1) * 23 / np.sqrt(len(v))

    chosen = set(sorted(p.units)[::2])
    inside = lambda q: (q.d == 1) & np.array([u in chosen for u in q.units])[None, :] & (q.t_on >= 2) & (q.t_on <= 4)
    row = estimands.estimand_intervals(got, "att", "overall", cells=F.col("unit").isin(*chosen), window=(2, 4)).first()
    assert abs(row["se"] - jackknife(lambda q, e: e[inside(q)].mean())) < 1e-8 and row["n_cells"] == int(inside(p).sum())
    for kind, value in (("aptt", lambda q, e, m: e[m].mean() / (q.y - e)[m].mean()), ("log_att", lambda q, e, m: (np.log(q.y[m]) - np.log((q.y - e)[m])).mean())):
        per = {r["at"]: r for r in estimands.estimand_intervals(got, kind).collect()}
        assert set(per) == {1.0, 2.0, 3.0, 4.0}
        for at, r in per.items():
            assert abs(r["se"] - jackknife(lambda q, e, f=value, at=at: f(q, e, (q.d == 1) & (q.t_on == at)))) < 1e-8
    cumulated = {r["at"]: r for r in estimands.estimand_intervals(got, "att_cumu", window=(1, 3)).collect()}
    whole = estimands.estimand_intervals(got, "att_cumu", "overall", window=(1, 3)).first()
    assert abs(cumulated[3.0]["value"] - whole["value"]) < 1e-12 and abs(cumulated[3.0]["se"] - whole["se"]) < 1e-12
    # one treated unit alone: leaving it out leaves no cell, which is a failed replicate
    one = estimands.estimand_intervals(got, "att", "overall", cells=F.col("unit") == min(u for i, u in enumerate(p.units) if p.ever[i])).first()
    assert one["n_reps"] == 23


def test_refusals_and_storage(spark):
    got = fit(simulated(spark), SPEC, FitOptions(), se=True, nboots=3)
    with pytest.raises(ValueError, match="keep_surface"):
        estimands.imputed_outcomes(got, replicates=True)
    with pytest.raises(ValueError, match="no estimand"):
        estimands.estimand_intervals(got, "aptt", "cohort")
    rows = spark.range(1000).withColumn("k", F.col("id") % 10)
    kept = stored.stored(rows, "k")
    assert kept.count() == 1000 and kept.columns == rows.columns and "stored-" in kept.inputFiles()[0]


def test_a_failed_replicate_counts_as_failed(spark):
    p = jobs.dense(fit(simulated(spark), SPEC, FitOptions()).cells)
    broken = p.take(np.arange(24))
    broken.use[:] = False
    rows = inference.surfaces(broken, FitOptions(), spark, "long", nboots=2).collect()
    assert len(rows) == 2 and all(r["unit"] is None and r["error"] for r in rows)
