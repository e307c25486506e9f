"""Recursive kernels shared by batch (one Arrow group per symbol) and streaming: (state, values) -> (state, results).

NaN marks a missing value here; callers turn it into NULL."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np


@dataclass
class GarchState:
    """Variance and shock of the last row; past holds (square, negative square, variance) of the last rows, latest first, where a model has more than one lag."""

    variance: float | None = None
    shock: float = 0.0
    past: list[list[float]] = field(default_factory=list)


def garch_lags(p: dict) -> tuple[list[float], list[float], list[float]]:
    """Weights of squared shocks, of negative ones and of variances, by lag; the first lag has no number."""
    out = []
    for name in ("alpha", "gamma", "beta"):
        w = [float(p.get(name, 0.0))]
        while f"{name}_{len(w) + 1}" in p:
            w.append(float(p[f"{name}_{len(w) + 1}"]))
        out.append(w)
    return out[0], out[1], out[2]


def garch_filter(state: GarchState, returns: np.ndarray, p: dict, start: float) -> tuple[GarchState, np.ndarray, np.ndarray]:
    """sigma of each row from earlier rows only, and the standardised shock. A missing return leaves the state as it is."""
    mu, omega = p.get("mu", 0.0), p.get("omega", 0.0)
    lags = garch_lags(p)
    (alpha, *_), (gamma, *_), (beta, *_) = lags
    m = max(map(len, lags))
    sigma, z = np.full(len(returns), np.nan), np.full(len(returns), np.nan)
    for i, r in enumerate(returns):
        if math.isnan(r):
            continue
        if state.variance is None:
            state.variance = start
        elif m > 1:
            state.variance = omega + sum(w * x[j] for j, ws in enumerate(lags) for w, x in zip(ws, state.past))
        else:
            e2 = state.shock * state.shock
            state.variance = omega + alpha * e2 + (gamma * e2 if state.shock < 0 else 0.0) + beta * state.variance
        state.shock = float(r - mu)
        if m > 1:
            e2 = state.shock * state.shock
            before = state.past or [[start, start / 2, start]] * m
            state.past = [[e2, e2 if state.shock < 0 else 0.0, float(state.variance)], *before[: m - 1]]
        sigma[i] = math.sqrt(state.variance)
        z[i] = state.shock / sigma[i]
    return state, sigma, z


def garch_forecast(p: dict, variance: float, shock: float, horizon: int, past: list[list[float]] | None = None) -> np.ndarray:
    """Variances of the next ``horizon`` rows; past as in GarchState for models of more than one lag."""
    out = np.empty(horizon)
    lags = garch_lags(p)
    m = max(map(len, lags))
    rows = [list(x) for x in past] if past else [[shock**2, shock**2 if shock < 0 else 0.0, variance]]
    for h in range(horizon):
        out[h] = p["omega"] + sum(w * x[j] for j, ws in enumerate(lags) for w, x in zip(ws, rows))
        rows = [[out[h], out[h] / 2, out[h]], *rows[: m - 1]]  # a shock ahead has its variance, half of it from below
    return out


@dataclass
class CusumState:
    """Two-sided page test on the log of squared shocks, standardised by in-control statistics."""

    mean: float = 0.0
    std: float = 1.0
    s_pos: float = 0.0
    s_neg: float = 0.0
    since: int = 0


def log_square(z: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(np.abs(z), 1e-4) ** 2)


def cusum_calibrate(state: CusumState, z: np.ndarray) -> CusumState:
    """New in-control statistics; the running sums stay."""
    v = log_square(z[~np.isnan(z)])
    if len(v) > 1:
        state.mean, state.std = float(v.mean()), float(v.std(ddof=1))
        if state.std < 1e-6:
            state.std = 1.0
    return state


def cusum(state: CusumState, z: np.ndarray, k: float = 0.5, h: float = 5.0) -> tuple[CusumState, dict[str, np.ndarray]]:
    """Alarms, the sums after a reset, and rows since the last alarm. Missing rows report no alarm, sums of 0 and the rows since the last alarm so far, and change nothing."""
    n = len(z)
    out = {"alarm_high": np.zeros(n, bool), "alarm_low": np.zeros(n, bool), "s_pos": np.zeros(n), "s_neg": np.zeros(n), "days_since": np.zeros(n, np.int64)}
    for i, v in enumerate(z):
        if math.isnan(v):
            out["days_since"][i] = state.since
            continue
        x = (math.log(max(abs(v), 1e-4) ** 2) - state.mean) / state.std
        state.s_pos = max(0.0, state.s_pos + x - k)
        state.s_neg = max(0.0, state.s_neg - x - k)
        high, low = state.s_pos > h, state.s_neg > h
        if high:
            state.s_pos = 0.0
        if low:
            state.s_neg = 0.0
        state.since = 0 if high or low else state.since + 1
        for name, value in zip(out, (high, low, state.s_pos, state.s_neg, state.since), strict=True):
            out[name][i] = value
    return state, out


def ewma_vol(returns: np.ndarray, lam: float = 0.94) -> np.ndarray:
    """Volatility from the squares of earlier returns, seeded with the first; missing returns repeat the last value."""
    out, v = np.full(len(returns), np.nan), math.nan
    for i in range(1, len(returns)):
        r = returns[i - 1]
        if not math.isnan(r):
            v = r * r if math.isnan(v) else lam * v + (1 - lam) * r * r
        if not math.isnan(v):
            out[i] = math.sqrt(v)
    return out


def emission_logs(x: np.ndarray, means: np.ndarray, covars: np.ndarray) -> np.ndarray:
    """Gaussian log densities (rows, states); full covariances (K, d, d) or diagonals (K, d)."""
    n, d = x.shape
    out = np.empty((n, len(means)))
    for k, mean in enumerate(means):
        c = covars[k]
        if c.ndim == 1:
            c = np.maximum(c, 1e-6)
            diff = x - mean
            out[:, k] = -0.5 * (d * math.log(2 * math.pi) + np.log(c).sum() + (diff**2 / c).sum(axis=1))
            continue
        root = np.linalg.cholesky((c + c.T) / 2 + 1e-6 * np.eye(d))
        y = np.linalg.solve(root, (x - mean).T)
        out[:, k] = -0.5 * (d * math.log(2 * math.pi) + 2 * np.log(np.diag(root)).sum() + (y**2).sum(axis=0))
    return out


def hmm_filter(alpha: np.ndarray | None, x: np.ndarray, p: dict) -> tuple[np.ndarray | None, np.ndarray]:
    """Filtered state probabilities. Rows with a missing feature keep the last state; before the first complete row they are NaN."""
    means, covars = np.asarray(p["means"], float), np.asarray(p["covars"], float)
    start, trans = np.maximum(np.asarray(p["startprob"], float), 1e-12), np.maximum(np.asarray(p["transmat"], float), 1e-12)
    full = ~np.isnan(x).any(axis=1)
    logs = np.full((len(x), len(means)), np.nan)
    if full.any():
        logs[full] = emission_logs(x[full], means, covars)
    out = np.full((len(x), len(means)), np.nan)
    for i in range(len(x)):
        if full[i]:
            prior = start if alpha is None else alpha @ trans
            w = np.log(np.maximum(prior, 1e-300)) + logs[i]
            alpha = np.exp(w - w.max())
            alpha /= alpha.sum()
        if alpha is not None:
            out[i] = alpha
    return alpha, out


def as_dict(state: object) -> dict:
    return asdict(state)
