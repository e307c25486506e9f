"""GARCH of general orders and skewed shocks."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from stressline.functions import dist
from stressline.functions import recursions as R
from stressline.models import garch as G


@pytest.mark.parametrize("nu, skew", [(4.5, -0.4), (7.0, 0.0), (30.0, 0.7), (2.5, 0.2)])
def test_skewed_t_is_a_density_with_mean_zero_and_its_quantile(nu, skew):
    x = np.sinh(np.linspace(-14, 14, 400_001))
    d = np.exp(dist.skewt_logpdf(x, nu, skew))
    area = lambda y: float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
    assert area(d) == pytest.approx(1, abs=1e-6) and area(d * x) == pytest.approx(0, abs=1e-5)
    if nu > 4:
        assert area(d * x * x) == pytest.approx(1, abs=1e-3)
    for q in (0.001, 0.05, 0.3, 0.5, 0.65, 0.99):
        z = dist.skewt_ppf(q, nu, skew)
        assert dist.skewt_cdf(z, nu, skew) == pytest.approx(q, abs=1e-10)
        assert area(np.where(x <= z, d, 0)) == pytest.approx(q, abs=1e-3)
    if skew == 0:
        assert np.allclose(dist.skewt_logpdf(x, nu, 0.0), dist.t_logpdf(x, nu, unit_variance=True))


def _returns(n, p, seed=1, skew=-0.3, nu=6.0):
    r = np.random.default_rng(seed)
    z = np.array([dist.skewt_ppf(u, nu, skew) for u in r.uniform(0.0005, 0.9995, n)])
    state, out = R.GarchState(), []
    past = [[1.0, 0.5, 1.0]] * 3
    a, g, b = R.garch_lags(p)
    for x in z:
        v = p["omega"] + sum(w * y[j] for j, ws in enumerate((a, g, b)) for w, y in zip(ws, past))
        e = x * np.sqrt(v)
        past = [[e * e, e * e if e < 0 else 0.0, v], *past[:2]]
        out.append(e)
    return np.array(out) + p["mu"], state


TRUE = {"mu": 0.05, "omega": 0.05, "alpha": 0.04, "alpha_2": 0.05, "gamma": 0.1, "beta": 0.5, "beta_2": 0.3}


@pytest.mark.parametrize("orders", [(1, 0, 1), (2, 1, 2), (1, 2, 1), (2, 0, 0), (3, 1, 1)])
@pytest.mark.parametrize("density", ["skewt", "normal"])
def test_the_filter_in_pieces_gives_the_fitted_likelihood(orders, density):
    x, _ = _returns(400, TRUE)
    f = G.fit_garch(x, p=orders[0], o=orders[1], q=orders[2], density=density)
    a, g, b = R.garch_lags(f)
    assert (len(a), len([k for k in f if k.startswith("gamma")]), len(b)) == (orders[0], max(1, orders[1]), max(1, orders[2]))
    assert min(a) >= 0 and min(u + d for u, d in zip(a, [*g, *[0.0] * 3])) >= -1e-12 and G.garch_summary(f)["persistence"] < 1
    state, s1, z1 = R.garch_filter(R.GarchState(), x[:150], f, f["start"])
    state = R.GarchState(**R.as_dict(state))
    _, s2, z2 = R.garch_filter(state, x[150:], f, f["start"])
    assert np.allclose(np.append(s1, s2), f["sigma"])
    z, s = np.append(z1, z2), f["sigma"]
    assert float((G.log_density(z, density, f["nu"], f.get("skew", 0.0)) - np.log(s)).sum()) == pytest.approx(f["loglik"], abs=1e-8)


def test_more_parameters_never_fit_worse_and_come_near_the_truth():
    x, _ = _returns(4000, TRUE)
    small, large = G.fit_garch(x, density="t"), G.fit_garch(x, p=2, o=1, q=2, density="skewt")
    assert large["loglik"] > small["loglik"] and large["n_params"] == 9
    assert G.garch_summary(large)["persistence"] == pytest.approx(0.94, abs=0.06)
    assert large["skew"] == pytest.approx(-0.3, abs=0.1) and large["nu"] == pytest.approx(6, abs=2)
    for k in ("mu", "omega", "alpha", "alpha_2", "gamma", "beta", "nu", "skew"):
        for h in (-1e-3, 1e-3):
            assert G.log_likelihood(x, large | {k: large[k] + h}, large["start"], "skewt") <= large["loglik"] + 2e-3
    ahead = R.garch_forecast(large, 0.0, 0.0, 400, [[1.0, 0.5, 1.0]] * 2)
    assert ahead[-1] == pytest.approx(G.garch_summary(large)["unconditional_variance"], rel=0.05)


def test_likelihood_at_the_returned_parameters_equals_recursive_sql():
    x, _ = _returns(300, TRUE)
    f = G.fit_garch(x, p=2, o=1, q=1, density="skewt")
    c = duckdb.connect()
    c.execute("create table x (i integer, r double)")
    c.executemany("insert into x values (?, ?)", list(enumerate(x.tolist())))
    p = {k: f"cast({f[k]!r} as double)" for k in ("mu", "omega", "alpha", "alpha_2", "gamma", "beta", "nu", "skew", "start")}
    sql = """with recursive k as (select exp(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2)) / sqrt(pi() * ({nu} - 2)) c), a as (select *, 4 * {skew} * c * ({nu} - 2) / ({nu} - 1) a from k), b as (select *, sqrt(1 + 3 * {skew} * {skew} - a * a) b from a),
    s as (select i, r - {mu} e, {start} v, {start} e2 from x where i = 0
          union all select x.i, x.r - {mu}, {omega} + ({alpha} + case when s.e < 0 then {gamma} else 0 end) * s.e * s.e + {alpha_2} * s.e2 + {beta} * s.v, s.e * s.e from s join x on x.i = s.i + 1)
    select sum(ln(b) + ln(c) - ({nu} + 1) / 2 * ln(1 + power((b * e / sqrt(v) + a) / case when e / sqrt(v) < -a / b then 1 - {skew} else 1 + {skew} end, 2) / ({nu} - 2)) - 0.5 * ln(v)) from s, b""".format(**p)
    assert c.execute(sql).fetchall()[0][0] == pytest.approx(f["loglik"], abs=1e-7)


def test_orders_are_checked():
    for bad in ({"p": 0}, {"o": -1}, {"q": -1}, {"density": "laplace"}):
        with pytest.raises(ValueError):
            G.fit_garch(np.arange(30.0), **bad)


def test_stream_of_a_model_with_two_lags(spark, tmp_path):
    from stressline.operators import filters as FL

    x, _ = _returns(60, TRUE)
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    p = TRUE | {"start": 1.0}
    got = [r["sigma"] for r in FL.garch_filter(spark.createDataFrame(rows, "symbol string, date date, return_pct double"), p).orderBy("date").collect()]
    assert np.allclose(got, np.sqrt(G.garch_variances(x - p["mu"], p, 1.0)))
