"""Early-warning areas by the plain rules: every row counts and a missing score is 0."""

import random

import pytest
from pyspark.sql import functions as F

from stressline.functions.prefix import running_totals
from stressline.operators import events as EV
from stressline.operators import stress as ST


def _areas(scores, labels):
    s = [0.0 if x is None else x for x in scores]
    pos, neg = [a for a, y in zip(s, labels) if y], [a for a, y in zip(s, labels) if not y]
    if not pos or not neg:
        return 0.5, 0.0
    roc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    points, pr = [(0.0, 1.0)], 0.0
    for cut in sorted(set(s), reverse=True):
        hit = [y for a, y in zip(s, labels) if a >= cut]
        points.append((sum(hit) / len(pos), sum(hit) / len(hit)))
    for (r0, p0), (r1, p1) in zip(points, points[1:]):
        pr += (r1 - r0) * (p1 + p0) / 2
    return roc, pr


def test_areas_with_missing_scores_and_a_hot_key(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.9 else "cold", None if r.random() < 0.3 else round(r.uniform(-1, 1), 2), int(r.random() < 0.2)) for _ in range(6000)]
    rows += [("gaps", None, 1), ("gaps", None, 0), ("gaps", -0.5, 0), ("one", 0.3, 1), ("none", None, 0)]
    got = {x["symbol"]: (x["roc_auc"], x["pr_auc"]) for x in EV.curve_areas(spark.createDataFrame(rows, "symbol string, score double, y int").repartition(4), "score", "y").collect()}
    for k in ("hot", "cold", "gaps", "one", "none"):
        assert got[k] == pytest.approx(_areas([s for a, s, _ in rows if a == k], [y for a, _, y in rows if a == k]))
    assert got["gaps"] == pytest.approx((0.75, (1 + 0.5) / 2))


def test_a_missing_level_scores_a_constant(spark):
    df = spark.range(200).select(
        F.lit("S").alias("symbol"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), F.col("id").cast("int").alias("rn"), (F.col("id") % 5 == 0).cast("int").alias("event_label"), (F.col("id") == 50).alias("crisis_onset"),
        F.lit(-1).alias("episode_id"), F.col("id").cast("double").alias("msi_headline"), F.when(F.col("id") > 20, F.col("id") / 100).alias("rv_20"), (-F.col("id") / 1000).alias("drawdown_252"),
    )
    got = {x["model"]: x for x in EV.compare_baselines(df).collect()}
    level = got["Level"]
    assert (level["roc_auc"], level["pr_auc"], level["spells"], level["mean_lead"], level["median_lead"], level["iqr_lead"]) == (0.5, pytest.approx((0.2 + 1) / 2), 0, 0, 0, 0)
    assert got["Realised volatility"]["tp"] + got["Realised volatility"]["fn"] == 40


@pytest.mark.parametrize("down", [False, True])
def test_running_totals_over_a_hot_key(spark, down):
    r = random.Random(5)
    seen = sorted({(r.choice("aaaaaab"), round(r.gauss(0, 1), 3)) for _ in range(4000)})
    rows = [(k, v, r.randrange(9)) for k, v in seen]
    got = {(x["k"], x["v"]): (x["n_upto"], x["n_all"]) for x in running_totals(spark.createDataFrame(rows, "k string, v double, n int").repartition(4), ["k"], "v", ["n"], descending=down, buckets=16).collect()}
    for key in "ab":
        mine, upto = sorted((x for x in rows if x[0] == key), key=lambda x: x[1], reverse=down), 0
        for k, v, n in mine:
            upto += n
            assert got[k, v] == (upto, sum(x[2] for x in mine))


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(50_000).select(F.when(F.col("id") >= 0, "one").alias("k"), F.rand(1).alias("v"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = running_totals(df, ["k"], "v", ["n"], buckets=16)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.agg(F.max("n_upto"), F.min("n_all")).first()[:] == (50_000, 50_000)


def test_distribution_flags(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([3, 1, 2, 2, 5, 3, 2.5])] + [("b", 9, 1.0)]
    out = ST.ecdf_columns(spark.createDataFrame(rows, "symbol string, rn int, x double"), {"p": "x"}, 4)
    got = {(r["symbol"], r["rn"]): (r["p"], r["p_exceeds"]) for r in out.collect()}
    assert got["a", 4] == (1.0, True) and got["a", 5] == (1.0, False) and got["a", 6] == (0.75, False) and got["b", 9] == (0.0, False)
