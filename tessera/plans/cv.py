"""Cross-validation: masks over usable cells, a job for each fold and candidate, scores as aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import jobs
from .spec import FitOptions

SCORES = ("mspe", "wmspe", "gmspe", "wgmspe", "mad", "moment", "gmoment", "rmse", "bias")


def rolling_mask(p: jobs.Dense, seed: int, prop: float = 0.1, nobs: int = 3, buffer: int = 1, min_t0: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hidden, scored): of a sample of units a random anchor's block is scored, and the buffer before it and all that
    follows are hidden. Ever-treated units offer their cells before onset only."""
    rng = np.random.default_rng(seed)
    first = np.where(p.ever, np.argmax(np.nan_to_num(p.d) == 1, axis=0), len(p.times))
    early = np.arange(len(p.times))[:, None] < first[None, :]
    usable = p.use & early
    eligible = np.flatnonzero(usable.sum(axis=0) >= min_t0 + nobs)
    if not len(eligible):
        raise ValueError("no unit has enough usable periods for cross-validation")
    hidden, scored = np.zeros_like(p.use), np.zeros_like(p.use)
    for i in rng.choice(eligible, max(1, round(prop * len(eligible))), replace=False):
        at = np.flatnonzero(usable[:, i])
        anchor = int(rng.integers(min_t0, len(at) - nobs + 1))
        scored[at[anchor : anchor + nobs], i] = True
        hidden[at[max(0, anchor - buffer) :], i] = True
    return hidden, scored


def block_mask(p: jobs.Dense, seed: int, prop: float = 0.1, nobs: int = 3, donut: int = 1, treated_only: bool = False, tries: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(hidden, scored): random blocks of ``nobs`` periods are hidden; all but ``donut`` cells at their edges are scored."""
    rng = np.random.default_rng(seed)
    pool = p.use & (p.ever[None, :] if treated_only else True)
    for _ in range(tries):
        hidden, scored = np.zeros_like(p.use), np.zeros_like(p.use)
        want = max(1, int(prop * pool.sum()))
        while hidden.sum() < want:
            t, i = (int(v) for v in rng.choice(np.argwhere(pool)))
            block = np.arange(t, min(t + nobs, len(p.times)))
            block = block[p.use[block, i]]
            hidden[block, i] = True
            inner = block[donut : len(block) - donut] if len(block) > 2 * donut else block
            scored[inner, i] = True
        rest = p.use & ~hidden
        if rest.any(axis=1).all() and rest[:, p.use.any(axis=0)].any(axis=0).all():
            return hidden, scored
    raise ValueError("no feasible mask")


def leave_one_out_mask(p: jobs.Dense, k: int, min_t0: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k-th usable pre-period (from the last) of every treated unit with enough others."""
    hidden = np.zeros_like(p.use)
    for i in np.flatnonzero(p.ever):
        at = np.flatnonzero(p.use[:, i])
        if len(at) > max(min_t0, k + 1):
            hidden[at[-1 - k], i] = True
    return hidden, hidden.copy()


def mask(p: jobs.Dense, kind: str, seed: int, **options) -> tuple[np.ndarray, np.ndarray]:
    if kind == "rolling":
        return rolling_mask(p, seed, **options)
    if kind == "loo":
        return leave_one_out_mask(p, seed, **options)
    return block_mask(p, seed, treated_only=kind == "treated_units", **options)


def period_weights(p: jobs.Dense, proportion: float = 0.3) -> dict[float, float]:
    """Weight of each event time up to 0 by its count against the mean; scarce ones weigh nothing."""
    at = p.t_on[(p.t_on <= 0) & p.obs]
    values, counts = np.unique(at, return_counts=True)
    counts = np.where(counts >= proportion * counts.max(initial=1), counts, 0)
    mean = counts[counts > 0].mean() if (counts > 0).any() else 1.0
    return dict(zip(values.tolist(), (counts / mean).tolist(), strict=True))


def _score_job(p: jobs.Dense, kind: str, params: dict):
    hidden, scored = mask(p, params["mask"], params["seed"], **params["mask_options"])
    got = jobs.fit_dense(p, use=p.use & ~hidden, **params["fit"])
    e = np.where(scored, p.y - got.y0, np.nan)
    ok = scored & np.isfinite(e)
    if not ok.any():
        raise ValueError("nothing is scored")
    weights = {float(k): v for k, v in params["weights"].items()}
    middle = float(np.median(list(weights.values()))) if weights else 1.0
    per = np.array([weights.get(float(t), middle) if np.isfinite(t) else middle for t in p.t_on[ok]])
    v = e[ok]
    at = np.where(np.isfinite(p.t_on[ok]), p.t_on[ok], 1e9)
    n = int(ok.sum())
    positive = v**2 > 0
    moments = [v[at == a].mean() for a in np.unique(at)]
    sizes = [int((at == a).sum()) for a in np.unique(at)]
    rows = {
        "mspe": (v**2).mean(), "wmspe": (per * v**2).sum() / max(per.sum(), 1e-300), "gmspe": np.exp(np.where(positive, np.log(np.maximum(v**2, 1e-300)), 0.0).mean()),
        "wgmspe": np.exp((per[positive] * np.log(v[positive] ** 2)).sum() / max(per[positive].sum(), 1e-300)) if positive.any() else 0.0, "mad": np.median(np.abs(v - np.median(v))),
        "moment": float(np.average(np.abs(moments), weights=sizes)), "gmoment": float(np.exp(np.average(np.log(np.maximum(np.abs(moments), 1e-300)), weights=sizes))),
        "rmse": np.sqrt((v**2).mean()), "bias": v.mean()}
    if params["fit"]["method"] == "probit":
        # y0 is a probability: how unlikely the hidden outcomes are
        chance = np.clip(got.y0[ok], 1e-12, 1 - 1e-12)
        rows["unlikelihood"] = -np.where(p.y[ok] > 0.5, np.log(chance), np.log(1 - chance)).mean()
    return [(name, float(params["candidate"]), float(value), n) for name, value in rows.items()]


def evaluate(p: jobs.Dense, candidates: list[dict], spark, base: dict, folds: int = 10, kind: str = "rolling", seed: int = 1, proportion: float = 0.3, **mask_options) -> DataFrame:
    """(candidate, fold, score, value, n_cells): every score of every candidate (fit arguments) on every fold."""
    weights = {str(k): v for k, v in period_weights(p, proportion).items()}
    rows = []
    for c, own in enumerate(candidates):
        for f in range(folds):
            params = {"candidate": c, "mask": kind, "seed": (seed * 1009 + f) if kind != "loo" else f, "mask_options": mask_options, "weights": weights, "fit": base | own}
            rows.append((c * folds + f, "score", params))
    got = jobs.run(p, jobs.table(spark, rows), _score_job, spark)
    return got.where("error is null").select(F.col("at").cast("int").alias("candidate"), (F.col("job_id") % folds).cast("int").alias("fold"), F.col("kind").alias("score"), "value", "n_cells")


def aggregate(scores: DataFrame, criterion: str = "mspe") -> DataFrame:
    """(candidate, mean, se, pooled, n_folds) of one score; se is 0 for a single fold."""
    rows = scores.where(F.col("score") == criterion)
    return rows.groupBy("candidate").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value") / F.sqrt(F.count("value").cast("double")), F.lit(0.0)).alias("se"),
        (F.sum(F.col("value") * F.col("n_cells")) / F.sum("n_cells")).alias("pooled"), F.count("value").alias("n_folds"))


def pick(table: DataFrame, rule: str = "1se") -> int:
    """The candidate that the rule takes: the smallest within one standard error of the best, the best, or the
    smallest within one per cent."""
    rows = sorted(table.collect(), key=lambda r: r["candidate"])  # one row a candidate
    best = min(rows, key=lambda r: (r["mean"], r["candidate"]))
    limit = {"1se": best["mean"] + best["se"], "min": best["mean"], "1pct": 1.01 * best["mean"]}[rule]
    return next(r["candidate"] for r in rows if r["mean"] <= limit)


def ranks(p: jobs.Dense, low: int, high: int, extra: int = 0) -> list[int]:
    """Ranks that leave degrees of freedom and are below every fitted unit's number of usable cells."""
    t, n = p.y.shape
    fewest = int(p.use.sum(axis=0)[p.use.any(axis=0)].min())
    k = p.x.shape[2] + extra
    return [r for r in range(low, high + 1) if p.use.sum() - r * (n + t) + r * r - k > 0 and r < fewest] or [low]


def penalties(p: jobs.Dense, force: str, n: int = 10) -> list[float]:
    """Penalties over three decades below the one that leaves no low-rank part; the last is 0."""
    top = kernels.largest_penalty(p.y, p.use, p.x, force)
    return [float(v) for v in top * 10.0 ** np.linspace(0, -3, max(n - 1, 1))] + [0.0]


def choose(p: jobs.Dense, options: FitOptions, spark, folds: int = 10, seed: int = 1, rule: str = "1se", kind: str = "rolling") -> dict:
    """Rank or penalty by the criterion; ``both`` keeps the factor model unless matrix completion scores better. A probit model's rank
    is chosen by the likelihood of hidden outcomes."""
    low, high = options.r if isinstance(options.r, tuple) else (0, 5)
    base = {"force": options.force, "sample": options.sample, "tol": max(options.tol, 1e-3), "max_iter": options.max_iter}
    found = []
    if options.method in ("ife", "both", "cfe"):
        rs = ranks(p, low, high)
        method = "cfe" if options.method == "cfe" else "ife"
        if options.criterion == "pc":
            values = [(jobs.fit_dense(p, r=r, method=method, **base).pc, r) for r in rs]
            return {"method": method, "r": min(values)[1], "lam": None}
        table = aggregate(evaluate(p, [{"method": method, "r": r} for r in rs], spark, base, folds, kind, seed, options.proportion), options.criterion).cache()
        k = pick(table, rule)
        found.append((table.where(F.col("candidate") == k).first()["mean"], {"method": method, "r": rs[k], "lam": None}))
    if options.method == "probit":
        rs = ranks(p, low, high)
        base["solver"] = options.probit_solver  # the loose tolerance also keeps separated units' indices from growing on
        table = aggregate(evaluate(p, [{"method": "probit", "r": r} for r in rs], spark, base, folds, kind, seed, options.proportion), "unlikelihood").cache()
        k = pick(table, rule)
        return {"method": "probit", "r": rs[k], "lam": None, "score": table.where(F.col("candidate") == k).first()["mean"]}
    if options.method in ("mc", "both"):
        ls = [options.lam] if options.lam is not None else penalties(p, options.force, options.n_lambda)
        table = aggregate(evaluate(p, [{"method": "mc", "lam": v} for v in ls], spark, base, folds, kind, seed, options.proportion), options.criterion).cache()
        k = pick(table, "min")
        found.append((table.where(F.col("candidate") == k).first()["mean"], {"method": "mc", "r": 0, "lam": ls[k]}))
    if not found:
        return {"method": options.method, "r": 0, "lam": None}
    return min(found, key=lambda f: f[0])[1]


def compare(p: jobs.Dense, models: dict[str, dict], spark, folds: int = 10, kind: str = "rolling", seed: int = 1) -> DataFrame:
    """(model, score, value, se): out-of-sample scores of named models (fit arguments) on the same folds."""
    names = sorted(models)
    got = evaluate(p, [models[n] for n in names], spark, {"tol": 1e-4, "max_iter": 1000}, folds, kind, seed)
    labels = F.array(*(F.lit(n) for n in names))
    return got.groupBy(F.element_at(labels, F.col("candidate") + 1).alias("model"), "score").agg(F.avg("value").alias("value"), F.coalesce(F.stddev_samp("value") / F.sqrt(F.count("value").cast("double")), F.lit(0.0)).alias("se"))


def score_residuals(cells: DataFrame) -> DataFrame:
    """All scores in one aggregation over cells (e, at, and wt if they weigh differently): mspe, gmspe, mad, moment, gmoment,
    rmse, bias, msptatt (mean squares of event-time means) and, with wt, wmspe and wgmspe."""
    e = F.col("e")
    weighted = []
    if "wt" in cells.columns:
        other = e != 0
        weighted = [(F.sum(F.col("wt") * e * e) / F.sum("wt")).alias("wmspe"), F.exp(F.sum(F.when(other, F.col("wt") * F.log(e * e))) / F.sum(F.when(other, F.col("wt")))).alias("wgmspe")]
    centre = cells.agg(F.percentile("e", F.lit(0.5)).alias("centre"))
    one = cells.join(F.broadcast(centre)).agg(
        F.avg(e * e).alias("mspe"), F.exp(F.avg(F.when(e != 0, F.log(e * e)).otherwise(0.0))).alias("gmspe"), F.percentile(F.abs(e - F.col("centre")), F.lit(0.5)).alias("mad"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count(e).alias("n_cells"), *weighted)
    per = cells.groupBy("at").agg(F.abs(F.avg(e)).alias("m"), F.count(e).alias("n"))
    moments = per.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("moment"), F.exp(F.sum(F.log("m") * F.col("n")) / F.sum("n")).alias("gmoment"),
        (F.sum(F.col("m") ** 2 * F.col("n")) / F.sum("n")).alias("msptatt"))

    return one.join(F.broadcast(moments))
