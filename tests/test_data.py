import datetime as dt

import pytest

from stressline.operators import features as FT
from stressline.operators import validation as VA
from stressline.sources import bars as B

D = [dt.date(2020, 1, i) for i in range(1, 31)]


def bars(spark, closes, symbol="A", dates=D):
    rows = [(symbol, d, c, c + 1.0, c - 1.0, c, 100.0) for d, c in zip(dates, closes, strict=False)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_clean_keeps_last_of_a_date(spark):
    rows = [(str(d), 1.0 * i, 2.0 + i, 0.5, 101.0 + i, 10) for i, d in enumerate(D[:5])] + [(str(D[4]), 1, 2, 0, 106, 10)]
    raw = spark.createDataFrame([(*map(str, r), i) for i, r in enumerate(rows)], "Date string, Open string, High string, Low string, Close string, Volume string, seq int")
    out = {x["date"]: x for x in B.clean_bars(raw, "X", "seq").collect()}
    assert len(out) == 5 and out[D[4]]["close"] == 106.0 and out[D[0]]["symbol"] == "X"


def test_clean_two_part_names_and_missing_columns(spark):
    raw = spark.createDataFrame([("2020-01-01 05:00:00", 1.0, 2.0, 0.5, 1.5)], "`Timestamp` string, `('Open', 'T')` double, `('High', 'T')` double, `('Low', 'T')` double, `('Close', 'T')` double")
    row = B.clean_bars(raw, "T").first()
    assert row["date"] == D[0] and row["close"] == 1.5 and row["volume"] == 0.0
    with pytest.raises(ValueError):
        B.clean_bars(raw.drop("('Low', 'T')"), "T")


def test_ohlc_flags(spark):
    rows = [("A", D[0], 100.0, 105.0, 99.0, 101.0), ("A", D[1], 100.0, 99.0, 98.0, 98.5), ("A", D[2], 100.0, 105.0, 101.0, 102.0), ("A", D[3], 100.0, 105.0, -5.0, 102.0), ("A", D[4], None, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double")
    assert [x["valid_ohlc"] for x in VA.validate_ohlc(df).orderBy("date").collect()] == [True, False, False, False, True]
    got = {x["rule"]: (x["violations"], x["dates"]) for x in VA.ohlc_violations(df).collect()}
    assert got == {"high_below_body": (1, [D[1]]), "low_above_body": (1, [D[2]]), "low_not_positive": (1, [D[3]])}


def test_lag_and_limit(spark):
    sec = bars(spark, [3000.0 + 10 * i for i in range(5)], "S")
    out = [x["sec_close"] for x in FT.align_to_calendar(bars(spark, [100.0 + i for i in range(5)]), sec, ["close"], lag=1).orderBy("date").collect()]
    assert out == [None, 3000.0, 3010.0, 3020.0, 3030.0]
    sec = bars(spark, [50.0, 60.0], "S", [D[0], D[7]])
    out = [x["sec_close"] for x in FT.align_to_calendar(bars(spark, [1.0] * 10), sec, ["close"]).orderBy("date").collect()]
    assert out == [50.0] * 4 + [None] * 3 + [60.0] * 3


def test_asof_takes_the_latest_before(spark):
    sec = bars(spark, [5.0, 6.0], "A", [D[0], D[2]])
    out = lambda strict: [x["sec_close"] for x in FT.asof_align(bars(spark, [1.0] * 4), sec, ["close"], strict=strict).orderBy("date").collect()]
    assert out(True) == [None, 5.0, 5.0, 6.0] and out(False) == [5.0, 5.0, 6.0, 6.0]


def test_quality_and_sources(spark, tmp_path):
    df = bars(spark, [100.0, 120.0, 121.0], dates=[D[0], D[1], D[9]]).union(bars(spark, [1.0], "B"))
    row = VA.quality_profile(df).where("symbol = 'A'").first()
    assert (row["n_rows"], row["large_moves"], row["gaps"], row["longest_gap_days"], row["volume_coverage_pct"]) == (3, 1, 1, 8, 100.0)
    B.write_bars_parquet(df, str(tmp_path / "cache"))
    assert B.read_bars_parquet(spark, str(tmp_path / "cache"), ["B"]).count() == 1
    assert B.file_hashes(spark, str(tmp_path / "cache")).where("path like '%parquet'").count() >= 2
    meta = {x["symbol"]: x for x in B.cache_metadata(df).collect()}
    assert meta["A"]["rows"] == 3 and meta["A"]["content_hash"] == B.cache_metadata(df.orderBy("close")).where("symbol = 'A'").first()["content_hash"]
    (tmp_path / "x.csv").write_text("DATE,Open,High,Low,Close\n2020-01-01,1,2,0.5,1.5\n")
    assert B.read_bars_csv(spark, str(tmp_path / "x.csv"), "C").first()["close"] == 1.5
    assert B.resolve(None, [df.limit(0), df], {"n": None}).count() == 4
    with pytest.raises(RuntimeError):
        B.resolve(None, [df.limit(0)], {})
