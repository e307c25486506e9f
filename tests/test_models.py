import numpy as np
import pytest

from stressline.functions import dist
from stressline.functions import recursions as R
from stressline.models import arma as A
from stressline.models import estimators as E
from stressline.operators import statistics as ST


def test_distributions():
    assert dist.t_ppf(0.99, 6) == pytest.approx(3.142668, abs=1e-5) and dist.t_cdf(dist.t_ppf(0.3, 4.5), 4.5) == pytest.approx(0.3)
    assert dist.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5) and dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-6)


def test_stationarity_decisions():
    r = np.random.default_rng(42)
    e = r.standard_normal(500)
    ar = np.zeros(500)
    for i in range(1, 500):
        ar[i] = 0.5 * ar[i - 1] + e[i]
    walk = np.cumsum(e)
    assert ST.adf(ar)["p_value"] < 0.05 < ST.adf(walk)["p_value"]
    assert ST.kpss(ar)["p_value"] >= 0.05 > ST.kpss(walk)["p_value"]


def test_verdicts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.01, 0.1), (0.5, 0.01), (0.01, 0.01), (0.5, 0.1)], "a double, k double")
    got = [x[0] for x in df.select(ST.stationarity_verdict(F.col("a"), F.col("k"))).collect()]
    assert got == ["Stationary", "Unit Root", "Inconclusive (Both Reject)", "Inconclusive (Neither Rejects)"]


def test_garch_recovers_and_filters_like_the_fit():
    r = np.random.default_rng(5)
    x, v, e = np.empty(2500), 1.0, 0.0
    for i in range(2500):
        v = 0.05 + 0.08 * e * e + 0.87 * v
        e = np.sqrt(v) * r.standard_t(6) * np.sqrt(4 / 6)
        x[i] = 0.02 + e
    g = E.fit_garch(x)
    s = E.garch_summary(g)
    assert 0.88 < s["persistence"] < 0.99 and 4 < g["nu"] < 10 and s["bic"] > s["aic"]
    _, sigma, z = R.garch_filter(R.GarchState(), np.append(x, [0.3, -4.0]), g, g["start"])
    assert np.allclose(sigma[:2500], g["sigma"]) and np.allclose(z[:2500], g["z"])
    state, part, _ = R.garch_filter(R.GarchState(), x[:1000], g, g["start"])
    _, rest, _ = R.garch_filter(state, x[1000:], g, g["start"])
    assert np.allclose(np.concatenate([part, rest]), g["sigma"])
    assert len(R.garch_forecast(g, 1.0, 0.5, 10)) == 10


def test_arma_stays_small():
    r = np.random.default_rng(42)
    x = np.zeros(300)
    for i in range(1, 300):
        x[i] = 0.2 * x[i - 1] + r.standard_normal()
    m = A.select_arma(x)
    assert m["p"] + m["q"] <= 2
    assert A.fit_arma(x, 1, 0, True)["coef"][1] == pytest.approx(0.2, abs=0.12)


def test_gpd_and_quantiles():
    r = np.random.default_rng(1)
    y = 1.5 / 0.2 * (r.random(20_000) ** -0.2 - 1)
    g = E.fit_gpd(y, q_u=0.0001)
    assert g["xi"] == pytest.approx(0.2, abs=0.03) and g["beta"] == pytest.approx(1.5, abs=0.06)
    z95, e95 = E.gpd_quantile_es(g, 0.95)
    z99, e99 = E.gpd_quantile_es(g, 0.99)
    assert z95 < z99 and e95 > z95 and e99 > z99
    z, _ = E.gpd_quantile_es({"u": 1.5, "xi": 0.0, "beta": 1.0, "n": 1000, "n_u": 100, "infinite_mean": False}, 0.99)
    assert z == pytest.approx(1.5 - np.log(0.1))
    assert E.fit_gpd(np.arange(60.0), q_u=0.9, least=50)["n_u"] >= 50


def test_hmm_filter_and_labels():
    p = {"startprob": [0.5, 0.3, 0.2], "transmat": [[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]], "means": [[0, 0], [1, 1], [3, 3]], "covars": [np.eye(2)] * 3}
    x = np.random.default_rng(0).standard_normal((250, 2))
    _, short = R.hmm_filter(None, x[:200], p)
    alpha, full = R.hmm_filter(None, x, p)
    assert np.allclose(full.sum(axis=1), 1) and np.abs(full[:200] - short).max() < 1e-12
    a, first = R.hmm_filter(None, x[:77], p)
    _, rest = R.hmm_filter(a, x[77:], p)
    assert np.allclose(np.vstack([first, rest]), full)
    x[:5] = np.nan
    _, late = R.hmm_filter(None, x, p)
    assert np.isnan(late[:5]).all() and not np.isnan(late[5:]).any()
    m = E.relabel({"startprob": [0.2, 0.3, 0.5], "transmat": np.eye(3), "means": [[2, 5], [0.5, 1], [1, 2]], "covars": [np.eye(2)] * 3}, 0, 1)
    assert m["order"].tolist() == [1, 2, 0]


def test_hmm_fit_finds_regimes():
    r = np.random.default_rng(3)
    s = np.repeat([0, 1, 0, 1], 200)
    x = np.column_stack([r.standard_normal(800) * np.where(s, 3, 1), np.where(s, 2.0, 0.0) + 0.3 * r.standard_normal(800)])
    m = E.fit_hmm(x, 2, starts=3)
    _, probs = R.hmm_filter(None, x, m)
    assert np.mean(probs.argmax(axis=1) == s) > 0.98 and m["means"][0, 1] < m["means"][1, 1]
    pi = E.stationary(np.asarray(m["transmat"]))
    assert pi.sum() == pytest.approx(1) and np.allclose(pi @ m["transmat"], pi, atol=1e-8) and (E.expected_durations(np.asarray(m["transmat"])) > 20).all()


def test_forest_cusum_pelt():
    r = np.random.default_rng(42)
    m = E.fit_forest(r.standard_normal((300, 3)))
    x = r.standard_normal((50, 3))
    x[10] = 10
    pct, over = E.ecdf(m["train"], E.forest_score(m, x))
    assert pct[10] >= 0.98 and over[10]
    z = r.standard_normal(150)
    z[100:115] *= 5
    state = R.cusum_calibrate(R.CusumState(), z[:90])
    _, out = R.cusum(state, z, 0.5, 3.0)
    assert out["alarm_high"][100:125].any()
    ends = E.pelt(np.concatenate([r.normal(0, 0.01, 100), r.normal(0, 0.04, 100)]), 3 * np.log(200))
    assert len(ends) == 2 and abs(ends[0] - 100) < 10
    assert len(E.pelt_grid(r.standard_normal(200))) == 7


def test_ecdf_and_weights():
    pct, over = E.ecdf(np.arange(1.0, 6), np.array([0.5, 3, 5, 10]))
    assert pct.tolist() == [0, 0.6, 1, 1] and over.tolist() == [False, False, False, True]
    assert E.ecdf(np.zeros(0), np.ones(2))[0].tolist() == [0, 0]
    r = np.random.default_rng(0)
    x, y = r.random((100, 4)), (r.random(100) < 0.2).astype(float)
    assert len(E.fit_logit(x, y)) == 5 and E.fit_logit(x[:40], y[:40]) is None
    w = E.pca_weights(x)
    assert w.sum() == pytest.approx(1) and E.pca_weights(x[:5]).tolist() == [0.25] * 4
