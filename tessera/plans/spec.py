"""What a panel analysis is asked to do: column roles and options, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The names of effects, estimators, samples and criteria that callers use.
FORCES = ("none", "unit", "time", "two-way")
METHODS = ("fe", "ife", "mc", "both", "gsc", "cfe", "probit")


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a long panel table."""

    y: str
    d: str
    unit: str
    time: str
    x: tuple[str, ...] = ()
    weight: str | None = None
    group: str | None = None
    cluster: str | None = None
    extra_fe: tuple[str, ...] = ()
    z: tuple[str, ...] = ()
    gamma: str | None = None
    q: tuple[str, ...] = ()
    kappa: str | None = None
    #: Weighs cells in averages of effects; without it ``weight`` does both.
    agg_weight: str | None = None

    def __post_init__(self):
        roles = [self.y, self.d, self.unit, self.time]
        if len(set(roles)) < 4:
            raise ValueError("outcome, treatment, unit and time must be four different columns")
        if set(self.x) & set(roles):
            raise ValueError("a covariate repeats the outcome, treatment, unit or time")
        if self.gamma and not self.z:
            raise ValueError("gamma needs z")
        if self.kappa and not self.q:
            raise ValueError("kappa needs q")

    @property
    def columns(self) -> list[str]:
        """Every column that the analysis reads, once each."""
        optional = [self.weight, self.agg_weight, self.group, self.cluster, self.gamma, self.kappa]
        return list(dict.fromkeys([self.unit, self.time, self.y, self.d, *self.x, *[c for c in optional if c], *self.extra_fe, *self.z, *self.q]))


def formula(text: str, unit: str, time: str, **roles) -> PanelSpec:
    """``"Y ~ D + X1 + X2"``: outcome, treatment, then covariates."""
    left, tilde, right = text.partition("~")
    terms = [t.strip() for t in right.split("+")]
    if not tilde or not left.strip() or not all(terms) or not all(t.isidentifier() for t in terms):
        raise ValueError(f"not a formula of plain column names: {text!r}")
    return PanelSpec(y=left.strip(), d=terms[0], x=tuple(terms[1:]), unit=unit, time=time, **roles)


@dataclass(frozen=True)
class FitOptions:
    """Estimator, masks and tuning. Defaults follow the usual ones of the method's papers."""

    method: str = "fe"
    force: str = "two-way"
    sample: str = "notyettreated"
    r: int | tuple[int, int] = 0
    lam: float | None = None
    n_lambda: int = 10
    tol: float = 1e-6
    max_iter: int = 2000
    min_t0: int | None = None
    max_missing: int | None = None
    carryover_rm: int = 0
    normalize: bool = False
    placebo: tuple[int, int] | None = None
    carryover: tuple[int, int] | None = None
    balance: tuple[int, int] | None = None
    fill_missing: bool = False
    proportion: float = 0.3
    criterion: str = "mspe"
    weight_fit: bool = True
    weight_agg: bool = True
    loading_bound: str = "none"
    gamma_loading: float | None = None
    keep_always_treated: bool = True
    #: How cross-validation masks cells and which candidate it takes.
    cv_method: str = "rolling"
    cv_rule: str = "1se"
    #: With fe on never-treated units whose cells have gaps: a period's level is the mean of the controls observed in it, instead of least squares.
    control_means: bool = False
    #: Fit factor and penalised models over the units' rows instead of one dense panel; panels too large to be collected always are.
    distributed: bool = False
    #: How the probit model's latent index is refitted: principal components (svd) or alternating regressions (qr).
    probit_solver: str = "svd"

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.force not in FORCES:
            raise ValueError(f"force must be one of {FORCES}")
        if self.sample not in ("notyettreated", "nevertreated"):
            raise ValueError("sample must be notyettreated or nevertreated")
        if self.placebo and self.carryover:
            raise ValueError("placebo and carryover tests exclude each other")
        if self.placebo and self.placebo[1] > 0:
            raise ValueError("a placebo window lies at event times up to 0")
        if self.carryover and self.carryover[0] <= 0:
            raise ValueError("a carryover window lies at exit times above 0")
        if self.balance and not (self.balance[0] <= 0 < self.balance[1]):
            raise ValueError("a balanced window reaches from 0 or less to 1 or more")
        if self.method in ("mc", "both") and self.sample == "nevertreated":
            raise ValueError("matrix completion needs the not-yet-treated sample")
        if self.method == "both" and self.criterion == "pc":
            raise ValueError("criterion pc can't compare interactive effects with matrix completion")
        if self.cv_method not in ("rolling", "all_units", "treated_units", "loo"):
            raise ValueError("cv_method must be rolling, all_units, treated_units or loo")
        if self.cv_rule not in ("1se", "min", "1pct"):
            raise ValueError("cv_rule must be 1se, min or 1pct")
        if self.probit_solver not in ("svd", "qr"):
            raise ValueError("probit_solver must be svd or qr")
        if self.criterion not in ("mspe", "gmspe", "moment", "pc"):
            raise ValueError("criterion must be mspe, gmspe, moment or pc")

    @property
    def effective_min_t0(self) -> int:
        return self.min_t0 if self.min_t0 is not None else (1 if self.method == "fe" else 5)

    def resolved(self) -> FitOptions:
        """gsc is an interactive model fitted on never-treated units."""
        return replace(self, method="ife", sample="nevertreated") if self.method == "gsc" else self
