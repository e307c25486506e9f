"""GARCH(p, o, q) by maximum likelihood: p lags of squared shocks, o of them again where the shock was negative, q of the variance; normal, Student t or skewed t shocks."""

from __future__ import annotations

import math

import numpy as np

from stressline.functions import dist
from stressline.functions.recursions import garch_lags
from stressline.models.optim import quasi_newton

DENSITIES = ("normal", "t", "skewt")


def lag_name(name: str, i: int) -> str:
    """The first lag has no number, so (1,1) models keep their plain names."""
    return name if i == 1 else f"{name}_{i}"


def garch_variances(e: np.ndarray, p: dict, start: float) -> np.ndarray:
    """Variance of each shock from earlier ones; before the series every square and variance is ``start``, half of it from negative shocks."""
    a, g, b = garch_lags(p)
    n, m = len(e), max(len(a), len(g), len(b))
    square = np.concatenate([np.full(m, start), e * e])
    negative = np.concatenate([np.full(m, start / 2), np.where(e < 0, e * e, 0.0)])
    drive = np.full(n, float(p["omega"]))
    for i, w in enumerate(a, 1):
        drive += w * square[m - i : m - i + n]
    for i, w in enumerate(g, 1):
        drive += w * negative[m - i : m - i + n]
    out = np.empty(n)
    if not n:
        return out
    out[0] = v = start
    if len(b) <= 1:
        beta = b[0] if b else 0.0
        for i, d in enumerate(drive[1:].tolist(), 1):
            v = d + beta * v
            out[i] = v
        return out
    past = [start] * len(b)
    for i, d in enumerate(drive[1:].tolist(), 1):
        v = d + sum(w * x for w, x in zip(b, past, strict=True))
        out[i] = v
        past = [v, *past[:-1]]
    return out


def log_density(z: np.ndarray, density: str, nu: float, skew: float) -> np.ndarray:
    """Of shocks with mean 0 and variance 1."""
    if density == "skewt":
        return dist.skewt_logpdf(z, nu, skew)
    if density == "t":
        return dist.t_logpdf(z, nu, unit_variance=True)
    return -0.5 * (math.log(2 * math.pi) + z * z)


def log_likelihood(r: np.ndarray, p: dict, start: float, density: str = "t") -> float:
    e = r - p["mu"]
    s2 = garch_variances(e, p, start)
    with np.errstate(all="ignore"):
        total = float((log_density(e / np.sqrt(s2), density, p.get("nu", math.inf), p.get("skew", 0.0)) - 0.5 * np.log(s2)).sum())
    return total if math.isfinite(total) else -math.inf


def fit_garch(returns: np.ndarray, *, leverage: bool = False, density: str = "t", p: int = 1, o: int | None = None, q: int = 1) -> dict:
    """Constant mean, on percent returns; leverage stands for o = 1. Squared shocks of either sign have weights from 0 on, and what persists stays below one, so
    alpha + gamma is never negative though gamma may be."""
    if density not in DENSITIES:
        raise ValueError(f"unknown density {density}")
    o = int(leverage) if o is None else o
    if p < 1 or o < 0 or q < 0:
        raise ValueError(f"no model of orders {p}, {o}, {q}")
    r = np.asarray(returns, float)
    r = r[~np.isnan(r)]
    m, v = float(r.mean()), float(max(r.var(), 1e-8))
    both = min(p, o)
    parts = 2 * both + (p - both) + (o - both) + q
    tail = {"normal": 0, "t": 1, "skewt": 2}[density]

    def unpack(x: np.ndarray) -> dict:
        total = 0.9999 / (1 + math.exp(-min(max(x[2], -500.0), 500.0)))  # persistence
        w = np.append(x[3 : 2 + parts], 0.0)
        w = np.exp(w - w.max())
        share = (total * w / w.sum()).tolist()
        out, at = {"mu": float(x[0])}, 0
        for i in range(1, both + 1):
            up, down = 2 * share[at], 2 * share[at + 1]  # weights of positive and of negative shocks, each half of the time
            out[lag_name("alpha", i)], out[lag_name("gamma", i)] = up, down - up
            at += 2
        for i in range(both + 1, p + 1):
            out[lag_name("alpha", i)] = share[at]
            at += 1
        for i in range(both + 1, o + 1):
            out[lag_name("gamma", i)] = 2 * share[at]
            at += 1
        for i in range(1, q + 1):
            out[lag_name("beta", i)] = share[at]
            at += 1
        out["omega"] = math.exp(min(x[1], 50.0)) * (1 - total)
        if tail:
            out["nu"] = 2.05 + math.exp(min(x[2 + parts], 6.0))
        if tail == 2:
            out["skew"] = 0.99 * math.tanh(x[3 + parts])
        return out

    def value(batch: np.ndarray) -> np.ndarray:
        ll = [log_likelihood(r, unpack(x), v, density) for x in batch]
        return np.array([-x / max(len(r), 1) if math.isfinite(x) else 1e12 for x in ll])

    # The last share is that of the last lag; before it most of the persistence is in the variance.
    shares = np.full(parts, -2.5 if q else 0.0)
    shares[parts - q :] = 0.0
    best = None
    for first in (3.0, 1.5):
        x0 = np.concatenate([[m, math.log(v), first], (shares - shares[-1])[:-1], [1.5, 0.0][:tail]])
        scale = np.concatenate([[math.sqrt(v)], np.ones(len(x0) - 1)])
        u, f = quasi_newton(lambda b: value(b * scale), x0 / scale, rounds=150, tol=1e-10)
        if best is None or f < best[1]:
            best = (u * scale, f)
    x, f = best
    out = unpack(x)
    e = r - out["mu"]
    sigma = np.sqrt(garch_variances(e, out, v))
    plain = {k: float(out.get(k, 0.0)) for k in ("mu", "omega", "alpha", "gamma", "beta")}
    more = {k: float(w) for k, w in out.items() if k not in plain and k not in ("nu", "skew")}
    shape = {"nu": float(out.get("nu", math.inf))} | ({"skew": float(out["skew"])} if tail == 2 else {})
    return {**plain, **more, **shape, "start": v, "loglik": log_likelihood(r, out, v, density), "n_params": 2 + parts + tail, "n": len(r), "sigma": sigma, "z": e / sigma}


def garch_summary(fit: dict) -> dict:
    """Persistence, long-run variance, half-life and information criteria."""
    a, g, b = garch_lags(fit)
    total = sum(a) + sum(b) + sum(g) / 2
    k, n, ll = fit["n_params"], fit["n"], fit["loglik"]
    return {
        "persistence": total,
        "unconditional_variance": fit["omega"] / (1 - total) if total < 1 else math.inf,
        "half_life": math.log(0.5) / math.log(total) if 0 < total < 1 else math.inf,
        "aic": 2 * k - 2 * ll,
        "bic": k * math.log(n) - 2 * ll,
    }
