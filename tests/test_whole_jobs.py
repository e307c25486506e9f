"""Registered queries do the operators' whole job: all rows, default settings."""

import datetime as dt

import numpy as np
import pytest

from stressline.models import arma as A
from stressline.models import estimators as E
from stressline.operators import features as FT
from stressline.plans import queries as Q


@pytest.fixture(scope="module")
def long_orders(spark, tmp_path_factory):
    """One series of 800 days whose returns follow an autoregression of order 3."""
    r = np.random.default_rng(7)
    x = np.zeros(800)
    for i in range(3, 800):
        x[i] = 0.6 * x[i - 3] + 0.01 * r.standard_normal()
    path = str(tmp_path_factory.mktemp("orders"))
    rows = [("1-URGENT", dt.date(1992, 1, 1) + dt.timedelta(days=i), float(p)) for i, p in enumerate(100 + 100 * x)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return path


def test_arma_select_tries_all_orders_on_all_rows(spark, long_orders):
    bars = FT.add_returns(Q.panel_bars(spark, long_orders)).orderBy("date").toPandas()
    x = bars["return_pct"].dropna().to_numpy(float)
    want = A.select_arma(x)
    got = Q.QUERIES["arma_select"](spark, long_orders).collect()
    assert len(x) > 700 and want["p"] == 3 and len(got) == 1
    assert (got[0]["p"], got[0]["q"], got[0]["constant"]) == (want["p"], want["q"], want["constant"])
    assert got[0]["bic"] == pytest.approx(want["bic"], abs=1e-3) and got[0]["forecast"] == pytest.approx(want["forecast"], abs=1e-3)


def test_walks_and_forests_use_the_default_settings(spark, long_orders, monkeypatch):
    seen = {}

    def note(name):
        def call(*args, **kwargs):
            seen[name] = (len(args), {k for k in kwargs if k not in ("keep",)})
            raise StopIteration

        return call

    for owner, f, name in ((Q.WF, "walk_forward", "walk_forward"), (Q.WF, "walk_forward", "walk_forward_scorecard"), (Q.AR, "arma_walk_forward", "arma_walk_forward"), (Q.EV, "block_bootstrap", "block_bootstrap")):
        with monkeypatch.context() as m:
            m.setattr(owner, f, note(name))
            if name.startswith("walk"):
                m.setattr(Q, "single_bars", lambda *_: Q.panel_bars(spark, long_orders))
            with pytest.raises(StopIteration):
                Q.QUERIES[name](spark, long_orders)
    assert seen == {"walk_forward": (1, set()), "walk_forward_scorecard": (1, set()), "arma_walk_forward": (2, set()), "block_bootstrap": (3, set())}


def test_iforest_uses_all_features_and_trees(spark, long_orders):
    df = FT.add_drawdowns(FT.add_volatility(FT.add_returns(Q.panel_bars(spark, long_orders)))).orderBy("date").toPandas()
    cols = list(Q.WF.WalkForwardConfig().forest_features)
    full = df[cols].notna().all(axis=1).to_numpy()
    x = df.loc[full, cols].to_numpy(float)
    want = E.forest_score(E.fit_forest(x[: max(50, len(x) // 2)], trees=300), x)
    got = Q.QUERIES["iforest"](spark, long_orders).orderBy("date").toPandas()
    assert len(got) == len(df) and np.allclose(got["score"][full], want, atol=1e-5)
    assert 0 < (~full).sum() == got["score"].isna().sum() and got.loc[~full, ["percentile", "flag"]].isna().all(axis=None)


def test_unknown_density_is_refused():
    with pytest.raises(ValueError):
        E.fit_garch(np.arange(50.0), density="cauchy")
