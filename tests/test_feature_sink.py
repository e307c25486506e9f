"""Windows over the written table need neither an exchange nor a sort."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stressline.sources import feature_sink as FS

from .test_features import panel


@pytest.fixture
def table(spark):
    name = "features_of_test"
    before = spark.conf.get(FS.ORDERED)
    spark.sql(f"drop table if exists {name}")
    yield name
    spark.sql(f"drop table if exists {name}")
    spark.conf.set(FS.ORDERED, before)


def _rows(df):
    return sorted(map(str, df.select("symbol", "date", "close").collect()))


def test_windows_without_exchange_and_sort(spark, table, tmp_path):
    bars = panel(spark, 80).drop("symbol").withColumn("symbol", F.explode(F.array(*(F.lit(f"S{i}") for i in range(9))))).repartition(5)
    out = FS.write_features(bars, table, path=f"{tmp_path}/t", buckets=4)
    assert _rows(out) == _rows(bars) and len(list((tmp_path / "t").glob("part-*.parquet"))) <= 4
    w = Window.partitionBy("symbol").orderBy("date")
    windowed = out.withColumns({"before": F.lag("close").over(w), "mean": F.avg("close").over(w.rowsBetween(-19, 0))})
    plan = windowed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" in plan
    want = bars.withColumns({"before": F.lag("close").over(w), "mean": F.avg("close").over(w.rowsBetween(-19, 0))})
    assert sorted(map(str, windowed.select("symbol", "date", "before", "mean").collect())) == sorted(map(str, want.select("symbol", "date", "before", "mean").collect()))
    grouped = out.groupBy("symbol").agg(F.max("close"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in grouped


def test_replacing_series(spark, table, tmp_path):
    bars = panel(spark, 30).drop("symbol").withColumn("symbol", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    FS.write_features(bars, table, path=f"{tmp_path}/1", buckets=4)
    new = bars.where("symbol = 'B'").withColumn("close", F.col("close") + 1).unionByName(bars.where("symbol = 'A'").withColumn("symbol", F.lit("D")))
    out = FS.replace_series(new, table, path=f"{tmp_path}/2")
    assert _rows(out) == _rows(bars.where("symbol <> 'B'").unionByName(new))
    plan = out.withColumn("x", F.sum("close").over(Window.partitionBy("symbol").orderBy("date")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
