"""Distribution functions, smoothers and bases that the diagnostics need, in numpy alone."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])


def norm_pdf(x):
    return np.exp(-0.5 * np.asarray(x, float) ** 2) / math.sqrt(2 * math.pi)


def norm_cdf(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 10000):
        an = -n * (n - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def f_cdf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)) if f > 0 else 0.0


def chi2_cdf(x: float, df: float) -> float:
    return gamma_inc(df / 2, x / 2)


def noncentral_f_cdf(f: float, d1: float, d2: float, ncp: float) -> float:
    """Poisson mixture of incomplete beta functions, summed outward from the mixture's mode."""
    if f <= 0:
        return 0.0
    x, half = d1 * f / (d1 * f + d2), ncp / 2
    centre = int(half)
    weight = lambda j: math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) if half > 0 else float(j == 0)
    total = 0.0
    for way in (range(centre, centre + 2000), range(centre - 1, -1, -1)):
        for j in way:
            w = weight(j)
            total += w * beta_inc(d1 / 2 + j, d2 / 2, x)
            if w < 1e-16 and j != centre:
                break
    return total


def loess(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, span: float = 0.75, degree: int = 2) -> np.ndarray:
    """Local quadratic regression with tricube weights, at the points themselves."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones_like(x) if w is None else np.asarray(w, float)
    k = max(degree + 1, int(math.ceil(span * len(x))))
    out = np.empty_like(y)
    for i, at in enumerate(x):
        d = np.abs(x - at)
        reach = max(np.sort(d)[min(k, len(d)) - 1], 1e-12) * (1.0001 if span < 1 else max(1.0, span))
        local = w * np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        design = np.vander(x - at, degree + 1, increasing=True)
        root = np.sqrt(local)
        out[i] = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0][0]
    return out


def spline_basis(t: np.ndarray, kind: str, degree: int = 3, df: int | None = None) -> np.ndarray:
    """Columns of time trends: linear, quadratic, cubic, or B-splines (without the intercept column)."""
    t = np.asarray(t, float)
    powers = {"linear": 1, "quadratic": 2, "cubic": 3}
    if kind in powers:
        return np.stack([t**k for k in range(1, powers[kind] + 1)], axis=1)
    if kind != "bspline":
        raise ValueError("a trend is linear, quadratic, cubic or bspline")
    df = df or max(degree + 1, min(degree + 2, len(np.unique(t))))
    inner = np.quantile(t, np.linspace(0, 1, df - degree + 2)[1:-1]) if df > degree else np.empty(0)
    low, high = t.min(), t.max()
    knots = np.concatenate([np.full(degree + 1, low), inner, np.full(degree + 1, high)])
    n = len(knots) - degree - 1
    basis = np.zeros((len(t), len(knots) - 1))
    for j in range(len(knots) - 1):
        basis[:, j] = (t >= knots[j]) & ((t < knots[j + 1]) | ((knots[j + 1] == high) & (t == high) & (knots[j] < high)))
    for d in range(1, degree + 1):
        new = np.zeros((len(t), len(knots) - 1 - d))
        for j in range(new.shape[1]):
            a, b = knots[j + d] - knots[j], knots[j + d + 1] - knots[j + 1]
            new[:, j] = ((t - knots[j]) / a * basis[:, j] if a > 0 else 0) + ((knots[j + d + 1] - t) / b * basis[:, j + 1] if b > 0 else 0)
        basis = new
    return basis[:, 1:n]


def tost_p(estimate: float, se: float, threshold: float) -> float:
    """Two one-sided tests that the estimate lies within the threshold of zero."""
    return max(1 - float(norm_cdf((estimate + threshold) / se)), float(norm_cdf((estimate - threshold) / se)))
