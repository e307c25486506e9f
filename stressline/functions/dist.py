"""Distribution functions without scipy: normal, Student t, chi-square."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_ppf(q: float) -> float:
    return _NORMAL.inv_cdf(q)


def norm_pdf(x: float) -> float:
    return _NORMAL.pdf(x)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _gamma_fraction(a: float, x: float) -> float:
    """Upper regularised gamma by Lentz's continued fraction, for x > a + 1."""
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def gamma_sf(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    if x > a + 1:
        return _gamma_fraction(a, x)
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-16:
        n += 1
        term *= x / n
        total += term
    return 1 - total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_sf(x: float, df: float) -> float:
    if x is None or math.isnan(x):
        return float("nan")
    if df == 1:
        return math.erfc(math.sqrt(max(x, 0) / 2))
    if df == 2:
        return math.exp(-max(x, 0) / 2)
    return gamma_sf(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_pdf(x: float, nu: float) -> float:
    return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - (nu + 1) / 2 * math.log1p(x * x / nu)) / math.sqrt(nu * math.pi)


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * beta_cdf(nu / (nu + x * x), nu / 2, 0.5)
    return 1 - tail if x > 0 else tail


def t_ppf(q: float, nu: float) -> float:
    if q == 0.5:
        return 0.0
    if q < 0.5:
        return -t_ppf(1 - q, nu)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, nu) < q:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, nu) < q else (lo, mid)
        if hi - lo < 1e-14 * max(1.0, hi):
            break
    return (lo + hi) / 2


def t_logpdf(x: np.ndarray, nu: float, unit_variance: bool = False) -> np.ndarray:
    s2 = (nu - 2) / nu if unit_variance else 1.0
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2) - (nu + 1) / 2 * np.log1p(x * x / (nu * s2))


def _skewt(nu: float, skew: float) -> tuple[float, float, float]:
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi * (nu - 2))
    a = 4 * skew * c * (nu - 2) / (nu - 1)
    return a, math.sqrt(1 + 3 * skew * skew - a * a), c


def skewt_logpdf(z: np.ndarray, nu: float, skew: float) -> np.ndarray:
    """Skewed t with mean 0 and variance 1: two halves of a t, the left one 1 - skew wide and the right one 1 + skew, joined at their mode; nu above 2, skew between -1 and 1."""
    a, b, c = _skewt(nu, skew)
    wide = np.where(z < -a / b, 1 - skew, 1 + skew)
    return math.log(b) + math.log(c) - (nu + 1) / 2 * np.log1p(((b * z + a) / wide) ** 2 / (nu - 2))


def skewt_cdf(z: float, nu: float, skew: float) -> float:
    a, b, _ = _skewt(nu, skew)
    y = (b * z + a) * math.sqrt(nu / (nu - 2))
    if z < -a / b:
        return (1 - skew) * t_cdf(y / (1 - skew), nu)
    return (1 - skew) / 2 + (1 + skew) * (t_cdf(y / (1 + skew), nu) - 0.5)


def skewt_ppf(q: float, nu: float, skew: float) -> float:
    a, b, _ = _skewt(nu, skew)
    scale = math.sqrt((nu - 2) / nu)
    if q < (1 - skew) / 2:
        return ((1 - skew) * scale * t_ppf(q / (1 - skew), nu) - a) / b
    return ((1 + skew) * scale * t_ppf(0.5 + (q - (1 - skew) / 2) / (1 + skew), nu) - a) / b
