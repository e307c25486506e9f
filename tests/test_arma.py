"""Exact-likelihood ARMA against dense Gaussian algebra, and the walk-forward against a plain loop."""

import datetime as dt

import numpy as np
import pytest

from stressline.models import arma as A
from stressline.plans import arma as AR
from stressline.plans import slices as SL


def _covariance(ar, ma, n):
    psi = np.zeros(6000)
    m = np.concatenate([[1.0], ma])
    for j in range(len(psi)):
        psi[j] = (m[j] if j < len(m) else 0) + sum(a * psi[j - i] for i, a in enumerate(ar, 1) if j >= i)
    g = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])
    return g[np.abs(np.arange(n)[:, None] - np.arange(n))]


@pytest.mark.parametrize("p, q", [(0, 0), (1, 0), (0, 1), (2, 1), (1, 3), (3, 3), (0, 3), (3, 0)])
def test_likelihood_and_forecast_equal_dense_algebra(p, q):
    r = np.random.default_rng(p * 10 + q)
    for n in (3, 64, 65, 200):
        ar, ma = A.from_partial(r.uniform(-0.95, 0.95, (4, p))), -A.from_partial(r.uniform(-0.95, 0.95, (4, q)))
        mean, x = r.normal(size=4), r.normal(size=n).cumsum() / 3
        ll, s2, ahead = A.log_likelihood(x, mean, ar, ma)
        for b in range(4):
            full = _covariance(ar[b], ma[b], n + 1)
            root = np.linalg.cholesky(full[:n, :n])
            z = np.linalg.solve(root, x - mean[b])
            assert s2[b] == pytest.approx(z @ z / n, rel=1e-8)
            assert ll[b] == pytest.approx(-0.5 * n * (np.log(2 * np.pi * z @ z / n) + 1) - np.log(np.diag(root)).sum(), abs=1e-8)
            assert ahead[b] == pytest.approx(full[n, :n] @ np.linalg.solve(full[:n, :n], x - mean[b]), abs=1e-7)


def test_partial_autocorrelations_round_trip():
    r = np.random.default_rng(2)
    for p in (1, 2, 3, 5):
        part = r.uniform(-0.99, 0.99, (20, p))
        coef = A.from_partial(part)
        for a, b in zip(coef, part, strict=True):
            assert np.allclose(A.to_partial(a), b)
            assert (np.abs(np.roots([1, *(-a)])) < 1).all()
    assert A.to_partial(np.array([1.2])) is None


def test_the_maximum_is_a_maximum():
    r = np.random.default_rng(4)
    e = r.normal(size=900)
    x = np.zeros(900)
    for i in range(2, 900):
        x[i] = 0.5 * x[i - 1] - 0.3 * x[i - 2] + e[i] + 0.4 * e[i - 1]
    f = A.fit_arma(x + 5, 2, 1, True)
    assert np.allclose(f["coef"], [5, 0.5, -0.3, 0.4], atol=0.15) and f["n_params"] == 5
    mean, ar, ma = f["coef"][:1], f["coef"][None, 1:3], f["coef"][None, 3:]
    for k in range(4):
        for h in (-1e-3, 1e-3):
            c = f["coef"].copy()
            c[k] += h
            assert A.log_likelihood(x + 5, c[:1], c[None, 1:3], c[None, 3:])[0][0] <= f["loglik"] + 1e-6
    assert A.log_likelihood(x + 5, mean, ar, ma)[0][0] == pytest.approx(f["loglik"])
    assert A.fit_arma(np.ones(50), 0, 0, True)["forecast"] == 1.0


def _series(spark, n, names="AB"):
    r = np.random.default_rng(7)
    rows = []
    for s in names:
        x = 0.0
        for i in range(n):
            x = 0.4 * x + float(r.normal())
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), i, None if i % 37 == 5 else x))
    return rows, spark.createDataFrame(rows, "symbol string, date date, rn int, v double")


def test_walk_forward_equals_a_plain_loop(spark):
    rows, df = _series(spark, 150)
    got = {(x["symbol"], x["rn"]): x["arma"] for x in AR.arma_walk_forward(df, "v", initial=80, refit=10, reselect=30, p_max=1, q_max=1).collect()}
    assert len(got) == 140
    for s in "AB":
        x = [v for a, _, _, v in rows if a == s]
        keep = lambda t: np.array([v for v in x[:t] if v is not None])
        picked, f = None, None
        for t in range(80, 150):
            if (t - 80) % 30 == 0:
                picked = A.select_arma(keep(t), p_max=1, q_max=1)
            if (t - 80) % 10 == 0:
                f = A.fit_arma(keep(t), picked["p"], picked["q"], picked["constant"])
            assert got[s, t] == pytest.approx(f["forecast"], abs=1e-9)


def test_short_series_are_named(spark):
    _, df = _series(spark, 80)
    with pytest.raises(Exception, match="series [AB] has no more than initial = 80 rows"):
        AR.arma_walk_forward(df, "v", initial=80).collect()


def test_a_slice_gets_a_series_once(spark):
    import pandas as pd

    _, df = _series(spark, 60)
    out = SL.by_slice(df, ["v"], 3, lambda rows, k: pd.DataFrame({"symbol": rows["symbol"][:1], "slice": [k], "n": [len(rows)], "ok": [bool(rows["rn"].is_monotonic_increasing)]}), "symbol string, slice int, n int, ok boolean")
    assert sorted(map(tuple, out.collect())) == [(s, k, 60, True) for s in "AB" for k in range(3)]
