"""The distributed forest against local trees grown from the same samples."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stressline.models import estimators as E
from stressline.operators import anomaly as AN
from stressline.plans import queries as Q

COLS = ["a", "b", "c"]


def _panel(spark, n=400):
    r = np.random.default_rng(1)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), *(None if r.random() < 0.02 else float(v) for v in r.standard_normal(3) * (8 if i == 7 else 1))) for s in "XYZ" for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double")


@pytest.mark.parametrize("parts", [1, 7])
def test_trees_equal_local_ones_on_the_same_samples(spark, parts):
    df = _panel(spark).repartition(parts)
    model = AN.fit_panel_forest(df, COLS, ["symbol", "date"], trees=12, sample=32, seed=5)
    full = df.dropna().toPandas()
    mean, std = full[COLS].to_numpy().mean(axis=0), full[COLS].to_numpy().std(axis=0)
    drawn = AN.bottom_k(df.dropna(), ["symbol", "date"], COLS, trees=12, sample=32, seed=5).toPandas()
    assert drawn.groupby("tree").size().tolist() == [32] * 12 and not drawn.duplicated(["tree", "symbol", "date"]).any()
    hashes = df.dropna().select("symbol", "date", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tree")).withColumn("h", F.xxhash64(F.lit(5), "tree", "symbol", "date")).toPandas()
    for t in range(12):
        least = hashes[hashes["tree"] == t].nsmallest(32, "h")
        mine = drawn[drawn["tree"] == t]
        assert set(zip(least["symbol"], least["date"])) == set(zip(mine["symbol"], mine["date"]))
    trees = []
    for t in range(12):
        x = drawn[drawn["tree"] == t].sort_values([*COLS, "symbol", "date"])[COLS].to_numpy()
        trees.append({"n": 32} | E.grow_tree((x - mean) / std, np.random.default_rng([5, t])))
    want = E.join_trees(trees, mean, std)
    for k in want:
        assert np.allclose(model[k], want[k]), k


def test_scores_percentiles_and_missing_features(spark):
    df = _panel(spark)
    train = F.dayofyear("date") <= 200
    got = AN.panel_forest(df, COLS, train=train, trees=50, sample=64).toPandas()
    assert len(got) == 1200
    model = AN.fit_panel_forest(df.where(train), COLS, ["symbol", "date"], trees=50, sample=64)
    rows = df.toPandas()
    full = rows[COLS].notna().all(axis=1)
    both = rows.merge(got, on=["symbol", "date"])
    assert both.loc[~full, ["score", "percentile", "flag"]].isna().all(axis=None)
    want = E.forest_score(model, rows.loc[full, COLS].to_numpy())
    assert np.allclose(both.loc[full, "score"].astype(float), want)
    used = np.sort(want[np.array([d.timetuple().tm_yday <= 200 for d in rows.loc[full, "date"]])])
    assert np.allclose(both.loc[full, "percentile"].astype(float), E.ecdf(used, want)[0])
    odd = both[[d.timetuple().tm_yday == 8 and d.year == 2020 for d in both["date"]]]
    assert odd["percentile"].astype(float).min() > 0.9


def test_small_tables(spark):
    df = _panel(spark, 10)
    assert AN.panel_forest(df, COLS, train=F.lit(True), trees=5).count() == 30
    with pytest.raises(ValueError):
        AN.panel_forest(df.where("a is null"), COLS, train=F.lit(True))


def test_queries_say_what_they_leave_out(spark, sf):
    hmm = Q.QUERIES["hmm_fit"](spark, sf).collect()
    assert len({x["symbol"] for x in hmm}) == 5 and all((x["regime"] is None) == (x["note"] is not None) for x in hmm)
    assert Q.QUERIES["panel_iforest"](spark, sf).count() == Q.panel_bars(spark, sf).count()
