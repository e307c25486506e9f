"""Names, weights, areas, moves, sources and refusals."""

import datetime as dt

import numpy as np
import pytest

from stressline.models import estimators as E
from stressline.operators import events as EV
from stressline.operators import features as FT
from stressline.operators import risk as RK
from stressline.operators import stress as SX
from stressline.operators import validation as VA
from stressline.plans import walk_forward as WF
from stressline.sources import bars as B

from .test_data import D, bars
from .test_features import panel


def test_regime_names():
    assert E.regime_names(4) == ("Calm", "Moderate", "Elevated", "Stress") and E.regime_names(5)[1] == "Moderate"
    assert E.regime_names(7) == tuple(f"State_{i}" for i in range(7))


def test_contributions_of_a_weighted_index(spark):
    rows = [("A", D[0], 0.1, 0.2, 0.3, 0.1, None), ("A", D[1], None, 0.6, 0.4, None, 0.5)]
    df = spark.createDataFrame(rows, "symbol string, date date, c_hmm double, c_vol double, c_drawdown double, c_anomaly double, c_cross_asset double")
    w = {"c_hmm": 0.5, "c_vol": 0.3, "c_drawdown": 0.1, "c_anomaly": 0.1}
    for x in SX.contributions(df.withColumn("msi", SX.index_weighted(SX.COMPONENTS, w)), SX.COMPONENTS, w).collect():
        assert sum(x[f"contrib_{c[2:]}"] or 0 for c in SX.COMPONENTS) == pytest.approx(x["msi"])


def test_precision_recall_area_equals_the_columns(spark):
    r = np.random.default_rng(5)
    s, y = np.round(r.random(200), 1), (r.random(200) < 0.3).astype(int)
    df = spark.createDataFrame([("A", i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))], "symbol string, rn int, s double, y int")
    want = EV.curve_areas(df, "s", "y").first()
    assert EV.precision_recall_area(s, y) == pytest.approx(want["pr_auc"]) and EV.area(s, y) == pytest.approx(want["roc_auc"])
    got = EV.block_bootstrap(df, "s", "y", resamples=80).first()
    assert got["point"] == pytest.approx(want["pr_auc"]) and got["lower"] < got["point"] < got["upper"]
    with pytest.raises(ValueError):
        EV.block_bootstrap(df, "s", "y", metric="other")


def test_large_moves(spark):
    got = VA.large_moves(bars(spark, [100.0, 101.0, 120.0, 119.0, 90.0])).collect()
    assert [(x["date"], round(x["return_pct"], 3)) for x in got] == [(D[2], round(100 * np.log(120 / 101), 3)), (D[4], round(100 * np.log(90 / 119), 3))]


def test_mean_residual_life_by_hand(spark):
    r = np.random.default_rng(3)
    x = np.round(r.standard_t(4, 400), 2)
    got = {g["point"]: g for g in RK.mean_residual_life(spark.createDataFrame([("A", float(v)) for v in x], "symbol string, loss double"), "loss").collect()}
    lo, hi = np.quantile(x, [0.7, 0.98])
    for k in range(50):
        over = x[x > lo + (hi - lo) * k / 49]
        assert got[k]["n"] == len(over)
        if len(over) <= 10:  # no estimate from ten exceedances or fewer
            assert got[k]["mean_excess"] is None and got[k]["lower"] is None and got[k]["upper"] is None
        else:
            assert got[k]["mean_excess"] == pytest.approx((over - got[k]["threshold"]).mean(), abs=1e-9)
            assert got[k]["upper"] - got[k]["mean_excess"] == pytest.approx(1.96 * over.std(ddof=1) / np.sqrt(len(over)), abs=1e-9)


def test_rolling_quantiles_with_missing_returns(spark):
    r = np.random.default_rng(2)
    v = [None if r.random() < 0.1 else float(x) for x in r.standard_normal(420)]
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(v)], "symbol string, date date, return_pct double")
    got = RK.historical_var_panel(df, window=250, block=300).orderBy("date").toPandas()
    for i in (0, 100, 200, 300, 419):
        held = -np.array([x for x in v[max(0, i - 249) : i + 1] if x is not None])
        if len(held) < 125:
            assert np.isnan(got["var_hs_95"][i])
        else:
            q = np.quantile(held, 0.95)
            assert got["var_hs_95"][i] == pytest.approx(q) and got["es_hs_95"][i] == pytest.approx(held[held >= q].mean())


def test_series_are_cached_and_tried_again(spark, tmp_path):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return bars(spark, [1.0, 2.0, 3.0], "^A/B")

    load = lambda *s, **k: B.load_series(spark, "^A/B", f"file://{tmp_path}/c", s, sleep=waits.append, **k)
    assert load(lambda: None) is None
    assert load(flaky).count() == 3 and waits == [2.0, 4.0]
    assert sorted(x["close"] for x in load(lambda: 1 / 0).collect()) == [1.0, 2.0, 3.0]
    assert load(lambda: None, lambda: bars(spark, [9.0], "^A/B"), refresh=True).first()["symbol"] == "^A/B" and load().count() == 1


def test_two_secondary_series_are_refused(spark):
    two = bars(spark, [1.0, 2.0], "X").union(bars(spark, [3.0, 4.0], "Y"))
    with pytest.raises(Exception, match="several rows of one date"):
        FT.align_to_calendar(bars(spark, [5.0, 6.0]), two, ["close"]).collect()


def test_short_series_are_an_error(spark):
    df = FT.build_features(panel(spark, 300))
    with pytest.raises(Exception, match="no more than initial_train"):
        WF.walk_forward(df, WF.WalkForwardConfig(initial_train=290, cadence=20, hmm_starts=1, trees=5, hs_window=200)).refits.collect()


def test_diagonal_regimes():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (150, 2)), r.normal(4, 1, (150, 2))])
    fit = E.fit_hmm(x, 2, starts=2, sort_by=1, diagonal=True)
    assert all(np.count_nonzero(c - np.diag(np.diag(c))) == 0 for c in fit["covars"]) and abs(fit["means"][0]).max() < 0.5 < fit["means"][1].min()


@pytest.mark.parametrize("lag, window", [(0, 7), (1, 7), (0, 300), (2, 50)])
def test_rolling_tails_equal_sorted_frames(lag, window):
    from stressline.functions.order_stats import rolling_tails

    r = np.random.default_rng(6)
    x = np.round(r.standard_t(3, 400), 1)  # many ties
    x[r.random(400) < 0.1] = np.nan
    got = rolling_tails(x, (0.0, 0.5, 0.95, 1.0), window, lag=lag, least=3, first=20)
    for i in range(20, 400):
        frame = x[max(0, i - lag - window + 1) : i - lag + 1]
        frame = frame[~np.isnan(frame)]
        for j, q in enumerate((0.0, 0.5, 0.95, 1.0)):
            if len(frame) < 3:
                assert np.isnan(got[i - 20, 2 * j])
            else:
                v = np.quantile(frame, q)
                assert got[i - 20, 2 * j] == pytest.approx(v, abs=1e-12)
                assert got[i - 20, 2 * j + 1] == pytest.approx(frame[frame >= got[i - 20, 2 * j]].mean(), abs=1e-9)


def test_one_long_series_runs_in_several_groups(spark):
    r = np.random.default_rng(8)
    rows = [("A", D[0] + dt.timedelta(days=i), float(v)) for i, v in enumerate(r.standard_normal(2500))]
    df = spark.createDataFrame(rows, "symbol string, date date, return_pct double").repartition(3)
    whole = RK.historical_var_panel(df, window=250, block=10_000).orderBy("date").toPandas()
    cut = RK.historical_var_panel(df, window=250, block=250).orderBy("date").toPandas()
    assert len(cut) == 2500 and np.allclose(whole.iloc[:, 2:], cut.iloc[:, 2:], equal_nan=True)
    plan = RK.historical_var_panel(df)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "hashpartitioning(symbol" in plan and "_block" in plan
