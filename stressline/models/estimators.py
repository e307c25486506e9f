"""Estimators in numpy, each fitted to one series: they run inside grouped Arrow functions, one group a (symbol, refit)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from stressline.functions import dist
from stressline.functions.recursions import emission_logs
from stressline.models.garch import fit_garch, garch_summary  # noqa: F401 - among the estimators of this module


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float | np.ndarray = 0.1, *, tol: float = 1e-9, most: int = 2000) -> tuple[np.ndarray, float]:
    """Downhill simplex minimum."""
    n = len(x0)
    simplex = np.vstack([x0, x0 + np.eye(n) * step])
    value = np.array([f(p) for p in simplex])
    for _ in range(most):
        order = np.argsort(value)
        simplex, value = simplex[order], value[order]
        if abs(value[-1] - value[0]) <= tol * (abs(value[0]) + tol):
            break
        centre = simplex[:-1].mean(axis=0)
        move = lambda t: centre + t * (simplex[-1] - centre)  # noqa: E731, B023
        r = move(-1.0)
        fr = f(r)
        if fr < value[0]:
            e = move(-2.0)
            fe = f(e)
            simplex[-1], value[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < value[-2]:
            simplex[-1], value[-1] = r, fr
        else:
            c = move(-0.5 if fr < value[-1] else 0.5)
            fc = f(c)
            if fc < min(fr, value[-1]):
                simplex[-1], value[-1] = c, fc
            else:
                simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
                value[1:] = [f(p) for p in simplex[1:]]
    best = int(np.argmin(value))
    return simplex[best], float(value[best])


# --- tails ------------------------------------------------------------------------------------------------------------


def fit_gpd(losses: np.ndarray, *, q_u: float = 0.90, least: int = 50) -> dict:
    """Peaks over a percentile threshold (lowered where fewer than ``least`` exceed it); the shape is the maximum of the
    one-dimensional profile in theta = shape / scale."""
    x = np.asarray(losses, float)
    x = x[~np.isnan(x)]
    n = len(x)
    u = float(np.quantile(x, q_u)) if n else math.nan
    y = x[x > u] - u
    if len(y) < least <= n:
        u = float(np.quantile(x, (n - least) / n))
        y = x[x > u] - u
    base = {"u": u, "n": n, "n_u": len(y)}
    if len(y) < 10:
        return base | {"xi": 0.1, "beta": float(x.std()) if n else math.nan, "infinite_mean": False}

    def shape(theta: float) -> float:
        return float(np.log1p(theta * y).mean())

    def profile(theta: float) -> float:
        if abs(theta) < 1e-9:
            return len(y) * (math.log(y.mean()) + 1)
        xi = shape(theta)
        scale = xi / theta
        return len(y) * (math.log(scale) + 1 + xi) if scale > 0 else math.inf

    low = -1 / y.max() * (1 - 1e-6)
    grid = np.concatenate([low * (1 - np.geomspace(1e-4, 1, 60)), [0.0], np.geomspace(1e-4, 20, 120) / y.mean()])
    value = np.array([profile(t) for t in grid])
    at = int(np.nanargmin(value))
    lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    lo, hi = min(lo, hi), max(lo, hi)
    for _ in range(80):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if profile(a) < profile(b) else (a, hi)
    theta = (lo + hi) / 2
    xi, beta = (0.0, float(y.mean())) if abs(theta) < 1e-9 else (shape(theta), shape(theta) / theta)
    return base | {"xi": xi, "beta": beta, "infinite_mean": xi >= 1.0}


def gpd_quantile_es(fit: dict, q: float, losses: np.ndarray | None = None) -> tuple[float, float]:
    p = fit["n"] / fit["n_u"] * (1 - q) if fit["n_u"] else 1e-6
    p = p if p > 0 else 1e-6
    u, xi, beta = fit["u"], fit["xi"], fit["beta"]
    z = u - beta * math.log(p) if abs(xi) <= 1e-6 else u + beta / xi * (p ** (-xi) - 1)
    if not fit["infinite_mean"] and xi < 0.999:
        es = (z + beta - xi * u) / (1 - xi)
        return z, es if es >= z else 1.05 * z
    if losses is None:
        return z, 1.15 * z
    tail = losses[losses >= z]
    return z, float(tail.mean()) if len(tail) else 1.1 * z


def fit_student_df(z: np.ndarray) -> float:
    """Degrees of freedom of a Student t with free location and scale, by maximum likelihood."""
    z = z[~np.isnan(z)]
    m, s = float(np.median(z)), float(z.std())

    def loss(x: np.ndarray) -> float:
        scale, nu = math.exp(x[1]), 1.0 + math.exp(min(x[2], 6.0))
        return -float((dist.t_logpdf((z - x[0]) / scale, nu) - x[1]).sum())

    x, _ = nelder_mead(loss, np.array([m, math.log(max(s, 1e-9)), 1.5]), 0.3)
    return 1.0 + math.exp(min(x[2], 6.0))


# --- regimes ----------------------------------------------------------------------------------------------------------


def _products(mats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the first 1 .. n matrices and the logs of what they were divided by: a doubling scan, log2(n) vectorised steps."""
    out, log = mats.copy(), np.zeros(len(mats))
    step = 1
    while step < len(mats):
        new = out[:-step] @ out[step:]
        size = np.maximum(new.max(axis=(1, 2)), 1e-300)
        total = log[:-step] + log[step:] + np.log(size)
        out[step:], log[step:] = new / size[:, None, None], total
        step *= 2
    return out, log


def _scaled(logs: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Forward and backward vectors (each row adds up to one), log likelihood, and scaled emissions."""
    top = logs.max(axis=1, keepdims=True)
    b = np.maximum(np.exp(logs - top), 1e-300)
    first = start * b[0]
    fwd, back = np.empty_like(b), np.full_like(b, 1 / b.shape[1])
    fwd[0], ll = first, float(np.log(first.sum()) + top.sum())
    if len(b) > 1:
        mats = trans[None] * b[1:, None, :]
        ahead, log = _products(mats)
        fwd[1:] = first @ ahead
        ll = float(np.log(max(fwd[-1].sum(), 1e-300)) + log[-1] + top.sum())
        behind, _ = _products(mats[::-1].transpose(0, 2, 1))
        back[:-1] = behind.sum(axis=1)[::-1]
    return fwd / fwd.sum(axis=1, keepdims=True), back / back.sum(axis=1, keepdims=True), ll, b


def hmm_parameters(k: int, d: int, full: bool = True) -> int:
    """Free parameters of a Gaussian hidden Markov model."""
    return k - 1 + k * (k - 1) + k * d + k * (d * (d + 1) // 2 if full else d)


def baum_welch(x: np.ndarray, p: dict, *, rounds: int = 200, tol: float = 1e-4, least_cov: float = 1e-3, diagonal: bool = False) -> dict:
    """Maximises the likelihood of a Gaussian hidden Markov model, with full or diagonal covariances, from a starting point."""
    start, trans, means, covars = (np.array(p[c], float) for c in ("startprob", "transmat", "means", "covars"))
    d, last = x.shape[1], -math.inf
    shape = np.eye(d) if diagonal else np.ones((d, d))
    covars = covars * shape
    for _ in range(rounds):
        fwd, back, ll, b = _scaled(emission_logs(x, means, covars), np.maximum(start, 1e-12), np.maximum(trans, 1e-12))
        g = fwd * back
        g /= g.sum(axis=1, keepdims=True)
        if ll - last < tol:
            break
        last = ll
        joint = fwd[:-1, :, None] * trans * (b[1:] * back[1:])[:, None, :]
        pairs = (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
        start = g[0]
        trans = np.maximum(pairs, 1e-12) / np.maximum(pairs, 1e-12).sum(axis=1, keepdims=True)
        w = g.sum(axis=0) + 1e-10
        means = g.T @ x / w[:, None]
        covars = np.stack([((x - m).T * g[:, j]) @ (x - m) / w[j] * shape + least_cov * np.eye(d) for j, m in enumerate(means)])
    return {"startprob": start, "transmat": trans, "means": means, "covars": covars, "loglik": ll, "occupancy": g.mean(axis=0)}


def hmm_start(x: np.ndarray, k: int, seed: int) -> dict:
    """A starting point: states by k-means from random rows."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-9
    means = x[rng.choice(len(x), k, replace=False)]
    for _ in range(15):
        near = (((x[:, None, :] - means) / scale) ** 2).sum(axis=2).argmin(axis=1)
        means = np.stack([x[near == j].mean(axis=0) if (near == j).any() else x[rng.integers(len(x))] for j in range(k)])
    spread = np.cov(x.T).reshape(x.shape[1], -1) + 1e-3 * np.eye(x.shape[1])
    covars = np.stack([np.cov(x[near == j].T).reshape(x.shape[1], -1) + 1e-3 * np.eye(x.shape[1]) if (near == j).sum() > x.shape[1] + 1 else spread for j in range(k)])
    return {"startprob": np.full(k, 1 / k), "transmat": np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), "means": means, "covars": covars}


def relabel(p: dict, sort_by: int, tie: int) -> dict:
    """States in rising order of the mean of one feature, ties by the variance of another."""
    means, covars = np.asarray(p["means"]), np.asarray(p["covars"])
    var = covars[:, tie, tie] if covars.ndim == 3 else covars[:, tie]
    order = np.lexsort((var, means[:, sort_by]))
    out = dict(p) | {"startprob": np.asarray(p["startprob"])[order], "transmat": np.asarray(p["transmat"])[np.ix_(order, order)], "means": means[order], "covars": covars[order], "order": order}
    if "occupancy" in p:
        out["occupancy"] = np.asarray(p["occupancy"])[order]
    return out


def fit_hmm(x: np.ndarray, k: int = 3, *, starts: int = 10, seed: int = 42, sort_by: int = 1, tie: int = 0, warm: dict | None = None, least_cov: float = 1e-3, diagonal: bool = False) -> dict:
    """The best of several random starts and, where given, the last fit; states in rising order of ``sort_by``."""
    tries = [hmm_start(x, k, seed + 100 * i) for i in range(starts)] + ([warm] if warm else [])
    fits = [baum_welch(x, p, least_cov=least_cov, diagonal=diagonal) for p in tries]
    best = max(fits, key=lambda f: f["loglik"])
    best["bic"] = hmm_parameters(k, x.shape[1], not diagonal) * math.log(len(x)) - 2 * best["loglik"]
    return relabel(best, sort_by, tie)


#: Fixed value: names of the regimes by their number, calmest first.
REGIME_NAMES = {
    2: ("Calm", "Stress"),
    3: ("Calm", "Elevated", "Stress"),
    4: ("Calm", "Moderate", "Elevated", "Stress"),
    5: ("Calm", "Moderate", "Elevated", "Stress", "Turbulent"),
}


def regime_names(k: int) -> tuple[str, ...]:
    """Names of k regimes; numbered states where there are no names for k."""
    return REGIME_NAMES.get(k) or tuple(f"State_{i}" for i in range(k))


def stationary(trans: np.ndarray) -> np.ndarray:
    k = len(trans)
    a = np.vstack([trans.T - np.eye(k), np.ones(k)])
    pi = np.clip(np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0], 0, None)
    return pi / pi.sum()


def expected_durations(trans: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(1 - np.diag(trans), 1e-12)


def stress_ahead(alpha: np.ndarray, trans: np.ndarray, horizons=(1, 5, 10)) -> dict[int, np.ndarray]:
    """Probability of the last state some rows ahead."""
    return {h: (alpha @ np.linalg.matrix_power(trans, h))[..., -1] for h in horizons}


# --- anomalies --------------------------------------------------------------------------------------------------------


def _path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """An isolation tree over all given rows as flat arrays: feature, cut, first child (-1 at a leaf) and path length at a leaf."""
    depth = max(1, math.ceil(math.log2(max(len(rows), 2))))
    feature, cut, left, value = [-1], [0.0], [-1], [0.0]
    todo = [(rows, 0, 0)]
    while todo:
        rows, level, node = todo.pop()
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(hi > lo)
        if level >= depth or len(rows) <= 1 or not len(open_):
            value[node] = level + float(_path(len(rows)))
            continue
        f = int(rng.choice(open_))
        c = float(rng.uniform(lo[f], hi[f]))
        at = len(feature)
        feature[node], cut[node], left[node] = f, c, at
        for _ in range(2):
            feature.append(-1), cut.append(0.0), left.append(-1), value.append(0.0)
        side = rows[:, f] <= c
        todo += [(rows[side], level + 1, at), (rows[~side], level + 1, at + 1)]
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "value": np.array(value)}


def join_trees(trees: list[dict], mean: np.ndarray, std: np.ndarray) -> dict:
    """A forest of trees whose rows were standardised by mean and std; each has its size n."""
    roots = np.cumsum([0, *(len(t["feature"]) for t in trees)])
    left = [np.where(np.asarray(t["left"]) >= 0, np.asarray(t["left"]) + r, -1) for t, r in zip(trees, roots[:-1], strict=True)]
    return {"mean": mean, "std": std, **{c: np.concatenate([np.asarray(t[c]) for t in trees]) for c in ("feature", "cut", "value")}, "left": np.concatenate(left), "roots": roots[:-1], "sample": max(t["n"] for t in trees)}


def fit_forest(x: np.ndarray, *, trees: int = 300, sample: int = 256, seed: int = 42) -> dict:
    """Isolation forest on standardised columns, as flat arrays, with the sorted scores of the training rows."""
    x = np.asarray(x, float)
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    xs = (x - mean) / std
    rng = np.random.default_rng(seed)
    size = min(sample, len(xs))
    grown = [{"n": size} | grow_tree(xs[rng.choice(len(xs), size, replace=False)], rng) for _ in range(trees)]
    model = join_trees(grown, mean, std)
    model["train"] = np.sort(forest_score(model, x))
    return model


def forest_score(m: dict, x: np.ndarray) -> np.ndarray:
    """Between 0 and 1; the higher, the easier a row is isolated."""
    xs = (np.asarray(x, float) - m["mean"]) / m["std"]
    rows = np.arange(len(xs))
    total = np.zeros(len(xs))
    for root in m["roots"]:
        node = np.full(len(xs), root)
        while (inner := m["left"][node] >= 0).any():
            f = m["feature"][node]
            step = m["left"][node] + (xs[rows, np.maximum(f, 0)] > m["cut"][node])
            node = np.where(inner, step, node)
        total += m["value"][node]
    return 2.0 ** (-(total / len(m["roots"])) / max(float(_path(m["sample"])), 1e-9))


def ecdf(train_sorted: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of training values up to x, and whether x exceeds them all; 0 and False without training values."""
    x = np.asarray(x, float)
    if not len(train_sorted):
        return np.zeros(len(x)), np.zeros(len(x), bool)
    return np.searchsorted(train_sorted, x, "right") / len(train_sorted), x > train_sorted[-1]


# --- breaks -----------------------------------------------------------------------------------------------------------


def pelt(x: np.ndarray, penalty: float, *, least: int = 40) -> list[int]:
    """Ends of the segments of least total normal cost plus penalty, with pruning."""
    x = np.asarray(x, float)
    n = len(x)
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    starts = np.array([0])
    for t in range(least, n + 1):
        old = np.flatnonzero(t - starts >= least)
        ok = starts[old]
        m = t - ok
        var = np.maximum((s2[t] - s2[ok]) / m - ((s1[t] - s1[ok]) / m) ** 2, 1e-10)
        cost = m * np.log(var)
        total = best[ok] + cost + penalty
        at = int(total.argmin())
        best[t], last[t] = total[at], ok[at]
        keep = np.ones(len(starts), bool)
        keep[old[best[ok] + cost > best[t]]] = False
        starts = np.append(starts[keep], t - least + 1)
    ends, t = [], n
    while t > 0:
        ends.append(t)
        t = int(last[t])
    return ends[::-1]


def pelt_grid(x: np.ndarray, factors=(1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0), *, least: int = 40) -> dict[float, list[int]]:
    return {c: pelt(x, c * math.log(len(x)), least=least) for c in factors}


# --- index weights ----------------------------------------------------------------------------------------------------


def pca_weights(x: np.ndarray) -> np.ndarray:
    """Absolute first loadings of the covariance, adding up to one; equal where they cannot be found."""
    x = x[~np.isnan(x).any(axis=1)]
    k = x.shape[1]
    if len(x) < 10:
        return np.full(k, 1 / k)
    _, vectors = np.linalg.eigh(np.cov(x.T))
    w = np.abs(vectors[:, -1])
    return w / w.sum() if w.sum() > 1e-8 else np.full(k, 1 / k)


def fit_logit(x: np.ndarray, y: np.ndarray, *, purge: int = 10, embargo: int = 5, c: float = 1.0) -> np.ndarray | None:
    """Balanced ridge logistic regression without the last purge + embargo rows: coefficients, then intercept. None where
    fewer than 50 rows are common, fewer than 30 remain or a class is missing."""
    ok = ~(np.isnan(x).any(axis=1) | np.isnan(y))
    x, y = x[ok], y[ok]
    if len(x) < 50:
        return None
    x, y = x[: len(x) - purge - embargo], y[: len(y) - purge - embargo]
    if len(x) < 30 or len(np.unique(y)) < 2:
        return None
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1 / c] * x.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a.T * (w * p * (1 - p))) @ a + ridge + 1e-10 * np.eye(len(b)), a.T @ (w * (p - y)) + ridge @ b)
        b = b - step
        if np.abs(step).max() < 1e-10:
            break
    return b
