import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stressline.operators import events as EV
from stressline.operators import risk as RK
from stressline.operators import stress as SX

from .test_data import D

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(1500)]


def _flags(spark, flags):
    return spark.createDataFrame([("A", DAYS[i], bool(b)) for i, b in enumerate(flags)], "symbol string, date date, b boolean")


def _tests(spark, flags, alpha):
    return RK.coverage_tests(RK.breach_counts(_flags(spark, flags), ["symbol"], "b"), F.lit(alpha)).first()


def test_coverage(spark):
    r = np.random.default_rng(0)
    even = np.zeros(1000, bool)
    even[r.choice(1000, 50, replace=False)] = True
    assert _tests(spark, even, 0.05)["kupiec_lr"] == pytest.approx(0, abs=1e-9)
    many = np.zeros(1000, bool)
    many[r.choice(1000, 150, replace=False)] = True
    assert _tests(spark, many, 0.05)["kupiec_p"] < 0.05
    run = np.zeros(500, bool)
    run[100:110] = True
    assert _tests(spark, run, 0.05)["christoffersen_p"] < 0.05
    none = _tests(spark, np.zeros(300, bool), 0.01)
    assert none["x"] == 0 and none["kupiec_lr"] == pytest.approx(-2 * 300 * np.log(0.99))


def test_shortfall_bootstrap_and_scorecard(spark):
    import pandas as pd

    r = np.random.default_rng(2)
    loss = r.standard_normal(400)
    out = RK.shortfall_bootstrap(pd.DataFrame({"loss": loss, "var": 1.645, "es": 2.06, "sigma": 1.0}))
    assert out["n_breaches"] == (loss > 1.645).sum() and 0 <= out["es_p"] <= 1
    rows = [("A", DAYS[i], -float(x), 1.645, 2.06, 9.0, 9.0) for i, x in enumerate(loss)]
    df = spark.createDataFrame(rows, "symbol string, date date, return_pct double, v1 double, e1 double, v2 double, e2 double")
    card = {x["model"]: x for x in RK.var_scorecard(RK.to_models(df, {"m1": ("v1", "e1"), "m2": ("v2", "e2")}, 0.05)).collect()}
    assert card["m1"]["breaches"] == out["n_breaches"] and card["m1"]["es_p"] == out["es_p"] and card["m2"]["traffic_light"] == "Red" and card["m2"]["es_p"] == 1.0


def test_rolling_var_both_ways(spark):
    r = np.random.default_rng(3)
    rows = [("A", DAYS[i], None if i % 50 == 0 else float(x)) for i, x in enumerate(r.standard_normal(420))]
    df = spark.createDataFrame(rows, "symbol string, date date, return_pct double")
    a = RK.historical_var(df, 0.95, window=250).orderBy("date").toPandas()
    b = RK.historical_var_panel(df, (0.95,), window=250).orderBy("date").toPandas()
    for c in ("var_hs_95", "es_hs_95"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True) and a[c].notna().sum() > 200
    strict = RK.historical_var(df, 0.95, window=250, strict_nulls=True).where("es_hs_95 is not null").count()
    assert strict < a["es_hs_95"].notna().sum()


def test_labels_onsets_episodes(spark):
    p = [100.0] * 50
    p[10], p[12], p[40] = 90.0, 88.0, 75.0
    df = spark.createDataFrame([("A", DAYS[i], x) for i, x in enumerate(p)], "symbol string, date date, close double")
    ev = EV.crisis_onsets(EV.label_events(df, h=5, x=0.05), refractory=20)
    rows = ev.orderBy("rn").collect()
    assert all(rows[i]["event_label"] == 1 for i in range(5, 10)) and rows[-1]["event_label"] == 0 and rows[-1]["fwd_min_ret"] is None
    assert sum(x["crisis_onset"] for x in rows) >= 1 and rows[5]["crisis_onset"] and rows[6]["episode_id"] == 0
    ep = EV.crisis_episodes(ev).where("episode_id = 0").first()
    assert ep["peak_date"] == DAYS[0] and ep["trough_price"] == 88.0 and ep["trough_date"] == DAYS[12]
    onset, _ = EV.scan_onsets(np.ones(45), 20)
    assert np.flatnonzero(onset).tolist() == [0, 20, 40]


def test_spells_and_evaluation(spark):
    on = {5, 6, 7, 10}
    rows = [("A", DAYS[i], i, i in on, 60.0 + i if i in on else 10.0, int(i == 15), i == 15, 0 if i == 15 else -1) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, date date, rn int, alarm boolean, score double, event_label int, crisis_onset boolean, episode_id long")
    spell = EV.alarm_spells(df, "alarm", max_gap=3, score="score").collect()
    assert len(spell) == 1 and spell[0]["duration_days"] == 6 and spell[0]["peak_msi"] == 70.0
    out = EV.evaluate_alarms(df, "alarm", "score", max_gap=3).first()
    assert out["episode_recall"] == 1.0 and out["spell_precision"] == 1.0 and out["mean_lead"] == 10
    assert EV.area(np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1])) == 1.0


def test_index(spark):
    rows = [("A", D[0], 0.1, 0.2, 0.0, 0.1, None), ("A", D[1], 0.5, 0.6, 0.4, 0.5, None), ("A", D[2], 0.9, 0.8, 0.7, 0.8, None), ("A", D[3], None, 0.5, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, date date, c_hmm double, c_vol double, c_drawdown double, c_anomaly double, c_cross_asset double")
    df = df.withColumn("msi", SX.aggregate_index(SX.COMPONENTS)).withColumn("band", SX.band("msi"))
    out = SX.contributions(SX.alarms(df, "msi"), SX.COMPONENTS).orderBy("date").collect()
    assert [round(x["msi"], 9) for x in out] == [10.0, 50.0, 80.0, 50.0] and [x["band"] for x in out] == ["Normal", "High Risk", "Severe", "High Risk"]
    assert [x["alarm_secondary"] for x in out] == [False, False, True, False]
    for x in out:
        assert sum(x[f"contrib_{c[2:]}"] or 0 for c in SX.COMPONENTS) == pytest.approx(x["msi"])
    w = df.select(SX.aggregate_index(SX.COMPONENTS, "W-PCA", weights={"c_hmm": 0.5, "c_vol": 0.3, "c_drawdown": 0.1, "c_anomaly": 0.1}).alias("w")).collect()
    assert w[0]["w"] == pytest.approx(100 * (0.05 + 0.06 + 0.01))
    with pytest.raises(ValueError):
        SX.aggregate_index(SX.COMPONENTS, "W-X")


def test_components_use_training_rows_only(spark):
    r = np.random.default_rng(1)
    rows = [("A", DAYS[i], i, float(r.random()), float(v), -float(r.random()), float(r.random())) for i, v in enumerate(r.random(100) + np.where(np.arange(100) > 95, 5, 0))]
    df = spark.createDataFrame(rows, "symbol string, date date, rn int, prob_stress double, conditional_vol double, drawdown_252 double, anomaly_percentile double")
    out = SX.build_components(df, 80).orderBy("rn").toPandas()
    train = np.sort(out["conditional_vol"][:80])
    assert np.allclose(out["c_vol"], np.searchsorted(train, out["conditional_vol"], "right") / 80)
    assert out["c_vol_exceeds"][96:].all() and ((out[["c_hmm", "c_vol", "c_drawdown", "c_anomaly"]] >= 0) & (out[["c_hmm", "c_vol", "c_drawdown", "c_anomaly"]] <= 1)).all().all()
