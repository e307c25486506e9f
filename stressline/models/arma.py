"""ARMA by exact Gaussian likelihood.

In state-space form the filter of an invertible ARMA has a gain that never changes once the state before the first value is given. So the series is filtered with that gain from a zero state, the
response of its innovations to the unknown first state is filtered beside it, and the first state, which has its stationary distribution, is integrated out: the likelihood is
exact and no gain varies in time. The filter runs over the series in blocks, each a few matrix products, for a batch of parameter vectors at once, which is how gradients and step
lengths are found. Coefficients come from partial autocorrelations between -1 and 1, so every autoregression that is tried is stationary and every moving average invertible; the
variance is concentrated out.
"""

from __future__ import annotations

import math

import numpy as np

from stressline.models.optim import quasi_newton

BLOCK = 64


def from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions with these partial autocorrelations; a row each."""
    n, p = r.shape
    out = np.zeros((n, p))
    for k in range(p):
        if k:
            out[:, :k] = out[:, :k] - r[:, k : k + 1] * out[:, :k][:, ::-1]
        out[:, k] = r[:, k]
    return out


def to_partial(phi: np.ndarray) -> np.ndarray | None:
    """Partial autocorrelations of one autoregression; None where it is not stationary."""
    phi = np.array(phi, float)
    out = np.zeros(len(phi))
    for k in range(len(phi) - 1, -1, -1):
        out[k] = phi[k]
        if abs(out[k]) >= 1:
            return None
        phi = (phi[:k] + out[k] * phi[:k][::-1]) / (1 - out[k] ** 2)
    return out


def _bounded(u: np.ndarray) -> np.ndarray:
    return u / np.sqrt(1 + u * u)


def _unbounded(r: np.ndarray) -> np.ndarray:
    r = np.clip(r, -0.98, 0.98)
    return r / np.sqrt(1 - r * r)


def _system(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrices and shock loadings of a batch; the observation is the first state."""
    n, p, q = len(ar), ar.shape[1], ma.shape[1]
    r = max(p, q + 1, 1)
    t, load = np.zeros((n, r, r)), np.zeros((n, r))
    t[:, :p, 0] = ar
    t[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    load[:, 0] = 1.0
    load[:, 1 : q + 1] = ma
    return t, load


def filtered(y: np.ndarray, mean: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, ...]:
    """For innovations v from a zero first state and their response R to that state: (v'v, R'v, R'R, state after the last value, its response).
    y is one series; mean, ar and ma have a row for each parameter vector. Only one block of v and R exists at a time."""
    t, load = _system(ar, ma)
    k, r = load.shape
    n = len(y)
    gain = np.einsum("bij,bj->bi", t, load)
    closed = t.copy()
    closed[:, :, 0] -= gain
    width = min(BLOCK, n)
    seen, push = np.zeros((k, width, r)), np.zeros((k, width, r))  # row j: first row of closed ** j; closed ** j @ gain
    seen[:, 0, 0], push[:, 0] = 1.0, gain
    power = closed
    for j in range(1, width):
        seen[:, j] = np.einsum("bi,bij->bj", seen[:, j - 1], closed)
        push[:, j] = np.einsum("bij,bj->bi", closed, push[:, j - 1])
        power = power @ closed
    lag = np.arange(width)[:, None] - np.arange(width)[None, :] - 1
    answer = np.where(lag >= 0, push[:, np.maximum(lag, 0), 0], 0.0)  # of a prediction to the values before it in the block
    state = np.concatenate([np.zeros((k, r, 1)), np.broadcast_to(np.eye(r), (k, r, r))], axis=2)
    vv, rv, rr = np.zeros(k), np.zeros((k, r)), np.zeros((k, r, r))
    for lo in range(0, n, width):
        part = y[lo : lo + width][None, :] - mean[:, None]
        w = part.shape[1]
        predicted = seen[:, :w] @ state
        v = part - predicted[:, :, 0] - (answer[:, :w, :w] @ part[:, :, None])[:, :, 0]
        respond = predicted[:, :, 1:]
        vv += (v * v).sum(axis=1)
        rv += (respond.transpose(0, 2, 1) @ v[:, :, None])[:, :, 0]
        rr += respond.transpose(0, 2, 1) @ respond
        if w < width:
            power = np.linalg.matrix_power(closed, w)
        state = power @ state
        state[:, :, 0] += np.einsum("bw,bwi->bi", part[:, ::-1], push[:, :w])
    return vv, rv, rr, state[:, :, 0], state[:, :, 1:]


def log_likelihood(x: np.ndarray, mean: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood at the best variance, that variance, one-step forecast without the mean) for a batch of parameters."""
    t, load = _system(ar, ma)
    k, r = load.shape
    n = len(x)
    both = np.einsum("bij,bkl->bikjl", t, t).reshape(k, r * r, r * r)
    shock = np.einsum("bi,bj->bij", load, load)
    with np.errstate(all="ignore"):
        vv, rv, rr, last, carry = filtered(x, mean, ar, ma)
        try:
            first = np.linalg.solve(np.eye(r * r) - both, shock.reshape(k, r * r, 1)).reshape(k, r, r)
        except np.linalg.LinAlgError:
            return np.full(k, -np.inf), np.ones(k), np.zeros(k)
        first -= shock  # the covariance of the state that predicts the first value
        bad = ~(np.isfinite(first).all(axis=(1, 2)) & np.isfinite(rr).all(axis=(1, 2)) & np.isfinite(vv))
        first[bad], rr[bad], rv[bad] = 0.0, 0.0, 0.0
        size, axes = np.linalg.eigh((first + first.transpose(0, 2, 1)) / 2)
        root = axes * np.sqrt(np.maximum(size, 0.0))[:, None, :]
        inner = np.eye(r) + root.transpose(0, 2, 1) @ rr @ root
        hv = root.transpose(0, 2, 1) @ rv[:, :, None]
        u = np.linalg.solve(inner, hv)
        s2 = np.maximum((vv - (hv * u).sum(axis=(1, 2))) / n, 1e-300)
        ll = -0.5 * n * (np.log(2 * math.pi * s2) + 1) - 0.5 * np.linalg.slogdet(inner)[1]
    ahead = last + (carry @ root @ u)[:, :, 0]
    return np.where(np.isfinite(ll) & ~bad, ll, -np.inf), s2, ahead[:, 0]


def _start(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients by least squares on lags and on the residuals of a long autoregression; zeros where they are not stationary and invertible."""
    n, long = len(x), max(p, q) + 8
    if n < 4 * long:
        return np.zeros(p), np.zeros(q)
    lags = lambda s, k, lo: np.column_stack([s[lo - i : len(s) - i] for i in range(1, k + 1)]) if k else np.zeros((len(s) - lo, 0))
    e = np.zeros(n)
    if q:
        design = lags(x, long, long)
        e[long:] = x[long:] - design @ np.linalg.lstsq(design, x[long:], rcond=None)[0]
    lo = long + q if q else p
    if not p + q:
        return np.zeros(0), np.zeros(0)
    b = np.linalg.lstsq(np.hstack([lags(x, p, lo), lags(e, q, lo)]), x[lo:], rcond=None)[0]
    r, s = to_partial(b[:p]), to_partial(-b[p:])
    return (np.zeros(p) if r is None else _unbounded(r)), (np.zeros(q) if s is None else _unbounded(s))


def fit_arma(x: np.ndarray, p: int, q: int, constant: bool, *, rounds: int = 100, tol: float = 1e-8) -> dict:
    """Maximum likelihood by quasi-Newton steps. coef: mean (if asked for), autoregression, moving average."""
    x = np.asarray(x, float)
    n = len(x)
    scale = float(x.std()) or 1.0
    shift = float(x.mean()) if constant else 0.0

    def parts(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean = shift + scale * u[:, 0] if constant else np.zeros(len(u))
        r = _bounded(u[:, int(constant) :])
        return mean, from_partial(r[:, :p]), -from_partial(r[:, p:])

    def value(u: np.ndarray) -> np.ndarray:
        return -log_likelihood(x, *parts(u))[0] / n

    k = p + q + int(constant)
    u = np.zeros(k)
    if p + q:
        u[int(constant) :] = np.concatenate(_start(x - shift, p, q))
        both = np.stack([u, np.zeros(k)])
        u = both[int(np.argmin(value(both)))]
    u, _ = quasi_newton(value, u, rounds=rounds, tol=tol)
    mean, ar, ma = parts(u[None])
    ll, s2, ahead = log_likelihood(x, mean, ar, ma)
    coef = np.concatenate([mean[:1] if constant else np.zeros(0), ar[0], ma[0]])
    return {
        "p": p, "q": q, "constant": constant, "n_params": k + 1, "loglik": float(ll[0]), "bic": (k + 1) * math.log(n) - 2 * float(ll[0]), "aic": 2 * (k + 1) - 2 * float(ll[0]), "sigma2": float(s2[0]), "coef": coef,
        "forecast": float(mean[0] + ahead[0]),
    }


def orders(p_max: int = 3, q_max: int = 3) -> list[tuple[int, int, bool]]:
    return [(p, q, c) for p in range(p_max + 1) for q in range(q_max + 1) for c in (True, False)]


def choose(fits: list[dict], within: float = 2.0) -> dict:
    """Of the orders within ``within`` of the least BIC, the one with fewest parameters, then least BIC."""
    least = min(f["bic"] for f in fits)
    return min((f for f in fits if f["bic"] <= least + within), key=lambda f: (f["n_params"], f["bic"]))


def select_arma(x: np.ndarray, *, p_max: int = 3, q_max: int = 3, within: float = 2.0) -> dict:
    return choose([fit_arma(x, *o) for o in orders(p_max, q_max)], within)
