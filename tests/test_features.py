import inspect
import math
import re

import numpy as np
import pytest

from stressline.operators import features as FT

from .test_data import bars


def panel(spark, n=300, seed=1):
    import datetime as dt

    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(0.0005 + 0.015 * r.standard_normal(n)))
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    rows = [("A", d, float(c), float(c * (1 + abs(a))), float(c * (1 - abs(b))), float(c), float(v), True) for d, c, a, b, v in zip(days, close, r.normal(0, 0.005, n), r.normal(0, 0.005, n), r.uniform(1e6, 5e6, n), strict=True)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, valid_ohlc boolean")


def test_returns_and_drawdown(spark):
    got = [x["return"] for x in FT.add_returns(bars(spark, [100.0, 110.0, 99.0])).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([math.log(1.1), math.log(0.9)])
    got = [x["drawdown"] for x in FT.add_drawdowns(bars(spark, [100.0, 120.0, 90.0, 110.0, 130.0, 65.0])).orderBy("date").collect()]
    assert got == pytest.approx([0, 0, -0.25, 110 / 120 - 1, 0, -0.5])


def test_rolling_needs_a_full_window(spark):
    pdf = FT.add_volatility(FT.add_returns(panel(spark, 100))).orderBy("date").toPandas()
    want = pdf["return"].astype(float).rolling(5).std() * math.sqrt(252)
    assert pdf["rv_5"].isna().sum() == 5 and np.allclose(pdf["rv_5"][5:], want[5:])
    assert np.allclose(pdf["skew_60_descriptive"][60:].astype(float), pdf["return"].astype(float).rolling(60).skew()[60:])
    assert np.allclose(pdf["kurt_60_descriptive"][60:].astype(float), pdf["return"].astype(float).rolling(60).kurt()[60:])


def test_truncation_changes_nothing(spark):
    bars_ = panel(spark)
    full = FT.build_features(bars_).orderBy("date").toPandas()
    for t in (100, 250):
        cut = FT.build_features(bars_.orderBy("date").limit(t)).orderBy("date").toPandas()
        for c in cut.columns:
            if cut[c].dtype.kind == "f":
                assert np.allclose(cut[c], full[c][:t], atol=1e-9, equal_nan=True), c


def test_features_never_look_ahead():
    code = inspect.getsource(FT)
    assert not re.search(r"F\.lead\(|unboundedFollowing|rowsBetween\([^)]*,\s*[1-9]", code)


def test_one_exchange_for_all_features(spark):
    plan = FT.build_features(panel(spark, 30))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan)) == 1
