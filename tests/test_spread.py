"""Factor and penalised models on panels too large to be collected, against the dense kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import jobs
from tessera.plans.fit import fit
from tessera.plans.spec import FitOptions, PanelSpec
from tessera.sources import simulate

SPEC = PanelSpec(y="y", d="d", unit="id", time="time", extra_fe=("half",))


@pytest.mark.parametrize("options", [{"method": "ife", "r": 0}, {"method": "cfe"}, {"method": "mc", "lam": 1e9}, {"method": "gsc", "r": 1}], ids=str)
def test_large_panels_are_not_collected(spark, monkeypatch, options):
    df = simulate.simulated(spark, n=24, t=12, n_treated=8, onset=8, tau=2.0, seed=2).withColumn("half", F.col("id") % 2)
    dense = jobs.dense
    monkeypatch.setattr(jobs, "DRIVER_BYTES", 0)
    monkeypatch.setattr(jobs, "dense", lambda *a: pytest.fail("the panel was collected"))
    got = fit(df, SPEC, FitOptions(tol=1e-9, **options), checked=False)
    p = dense(got.cells)
    o = got.options
    want = jobs.fit_dense(p, o.method, sample=o.sample, r=o.r, lam=o.lam, tol=1e-11, max_iter=5000).y0
    y0 = np.full(want.shape, np.nan)
    for r in got.cells.select("unit", "time_ix", "y0").collect():
        y0[p.index.index(r["time_ix"]), p.units.index(r["unit"])] = r["y0"] if r["y0"] is not None else np.nan
    assert np.allclose(y0, want, atol=1e-4, equal_nan=True)
