import dataclasses
import datetime as dt

import numpy as np
import pytest

from stressline.functions import recursions as R
from stressline.models import estimators as E
from stressline.operators import features as FT
from stressline.operators import filters as FL
from stressline.plans import walk_forward as WF
from stressline.streaming import stateful as SM

from .test_features import panel


def test_grid():
    assert WF.refit_grid(250, 150, 50) == [(0, 150, 200), (1, 200, 250)]
    with pytest.raises(ValueError):
        WF.refit_grid(190, 150, 50)


def test_end_to_end_with_missing_values_and_a_second_series(spark):
    bars = panel(spark, 560)
    other = panel(spark, 560, 9).where("day(date) <> 13")
    df = FT.add_cross_asset(FT.align_to_calendar(FT.build_features(bars), other, ["close"], lag=1), "sec_close", "sec")
    c = WF.WalkForwardConfig(initial_train=420, cadence=70, hmm_starts=1, trees=20, hs_window=200, corr="corr_sec_60")
    kept = {}
    out = WF.walk_forward(df, c, keep=lambda x, name: kept.setdefault(name, x.cache()))
    oos = out.oos.orderBy("date").toPandas()
    assert len(oos) == 140 and out.refits.count() == 2 and oos["refit_idx"].tolist() == [0] * 70 + [1] * 70
    for c_ in ("c_hmm", "c_vol", "c_drawdown", "c_anomaly", "c_cross_asset"):
        assert oos[c_].between(0, 1).all(), c_
    assert np.allclose(oos[["prob_calm", "prob_elevated", "prob_stress"]].sum(axis=1), 1)
    assert oos["msi_headline"].between(0, 100).all() and (oos["es_evt_99"] >= oos["var_evt_99"] - 1e-9).all()
    parts = oos[[x for x in oos.columns if x.startswith("contrib_")]].sum(axis=1)
    assert np.allclose(parts, oos["msi_eq"])
    assert out.scorecard.count() == 8 and out.early_warning.count() == 1 and out.baselines.count() == 4
    r0 = out.refits.where("refit_idx = 0").first()
    ret = df.orderBy("date").toPandas()["return_pct"].to_numpy(float)
    _, sigma, _ = R.garch_filter(R.GarchState(), ret[:490], r0["garch"], r0["garch"]["start"])
    assert np.allclose(sigma[420:], oos["conditional_vol"][:70])


def test_streams_equal_batches(spark, tmp_path):
    bars = FT.add_returns(panel(spark, 60)).where("return_pct is not null").select("symbol", "date", "return_pct")
    days = [x["date"] for x in bars.orderBy("date").collect()]
    for i in range(3):
        bars.where(bars["date"].between(days[i * 20], days[min(i * 20 + 19, len(days) - 1)])).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    p = {"mu": 0.0, "omega": 0.1, "alpha": 0.1, "beta": 0.8, "start": 1.0}
    hmm = {"startprob": [0.6, 0.4], "transmat": [[0.9, 0.1], [0.2, 0.8]], "means": [[0.0], [0.0]], "covars": [[[1.0]], [[4.0]]]}
    runs = {
        "cusum": (lambda d: SM.stream_cusum(d, "return_pct", mean=-1.0, std=2.0), FL.cusum(bars, "return_pct", mean=-1.0, std=2.0)),
        "garch": (lambda d: SM.stream_garch(d, "return_pct", p), FL.garch_filter(bars, p)),
        "hmm": (lambda d: SM.stream_hmm(d, ["return_pct"], hmm), FL.hmm_forward(bars, ["return_pct"], hmm).drop("regime")),
    }
    for name, (stream, batch) in runs.items():
        for i in range(3):
            src = spark.readStream.schema(bars.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            q = stream(src).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start() if i == 0 else None
            if q:
                q.awaitTermination()
        got, want = (x.orderBy("date").collect() for x in (spark.table(name), batch))
        assert len(got) == len(want) and all(str(a) == str(b) for a, b in zip(got, want, strict=True)), name


def test_bar_stream_drops_late_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(minutes=m), float(m)) for m in (5, 20, 70, 300)]
    schema = "event_type string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    for i, late in enumerate(([(400, 1.0)], [(30, 99.0), (900, 1.0)]), 1):  # a watermark counts from the second batch after it
        spark.createDataFrame([("a", t + dt.timedelta(minutes=m), v) for m, v in late], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = SM.stream_bars(src, late="1 hour").writeStream.format("memory").queryName("bars_").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    first = spark.table("bars_").orderBy("start").first()
    assert (first["open"], first["high"], first["volume"]) == (5.0, 20.0, 2)


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chained_regimes_are_never_worse_and_follow_a_plain_loop(spark):
    df = WF.label_panel(FT.build_features(panel(spark, 420)), WF.WalkForwardConfig(hs_window=200)).cache()
    c = WF.WalkForwardConfig(initial_train=300, cadence=30, hmm_starts=2)
    fits = {on: {x["refit_idx"]: x for x in WF.fit_regimes(df, dataclasses.replace(c, hmm_chain=on), 3).collect()} for on in (True, False)}
    assert sorted(fits[True]) == sorted(fits[False]) == [0, 1, 2, 3]
    rows = df.orderBy("date").toPandas()
    last = None
    for i, t in enumerate(range(300, 420, 30)):
        x = rows[list(c.hmm_features)].to_numpy(float)[:t]
        x = x[~np.isnan(x).any(axis=1)]
        cold = E.fit_hmm(x, 3, starts=2)
        best = E.fit_hmm(x, 3, starts=2, warm=last)
        assert fits[False][i]["loglik"] == pytest.approx(cold["loglik"], abs=1e-8)
        assert fits[True][i]["loglik"] == pytest.approx(best["loglik"], abs=1e-6) and fits[True][i]["loglik"] >= cold["loglik"] - 1e-8
        assert np.allclose(fits[True][i]["means"], best["means"], atol=1e-5)
        last = best
