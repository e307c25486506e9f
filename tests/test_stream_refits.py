"""A stream whose parameters are replaced at every refit against the batch walk-forward."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stressline.operators import features as FT
from stressline.plans import walk_forward as WF
from stressline.streaming import refits as SR

from .test_features import panel


@pytest.fixture(scope="module")
def walked(spark):
    c = WF.WalkForwardConfig(initial_train=300, cadence=40, hmm_starts=1, trees=5, hs_window=200)
    df = WF.label_panel(FT.build_features(panel(spark, 420)), c)
    df = df.withColumn("return_pct", F.when(F.col("rn") % 53 != 7, F.col("return_pct"))).cache()
    refits = WF.fit_refits(df, c).cache()
    return df, refits, WF.frozen_filter(df, refits, c).orderBy("date").toPandas(), c


def _play(spark, folder, name, steps, **options):
    before = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")}
    SR.use_state_store(spark)
    schema = steps[0].schema
    for i, rows in enumerate(steps):
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{i}")
        src = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        q = SR.filter_stream(src, **options).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-at").trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    for k, v in before.items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{folder}/{name}").orderBy("date").toPandas()


def test_stream_over_refit_blocks_equals_the_batch(spark, walked, tmp_path):
    df, refits, want, c = walked
    rows = SR.parameter_rows(df, refits, c).unionByName(SR.bar_rows(df.where("rn >= 300"), c))
    cuts = [None, *(want["date"][i] for i in (25, 40, 63, 100)), None]  # batches that end within blocks, and one at a refit
    steps = []
    for a, b in zip(cuts, cuts[1:]):
        part = rows
        if a is not None:
            part = part.where(F.col("date") >= F.lit(a))
        if b is not None:
            part = part.where(F.col("date") < F.lit(b))
        steps.append(part)
    got = _play(spark, str(tmp_path), "out", steps)
    assert len(got) == len(want) == 120 and got["refit_idx"].tolist() == want["refit_idx"].tolist() and set(want["refit_idx"]) == {0, 1, 2}
    for a, b in (("sigma", "conditional_vol"), ("z", "std_resid"), ("s_pos", "cusum_s_pos"), ("s_neg", "cusum_s_neg"), ("days_since", "days_since_cusum")):
        assert np.allclose(got[a].astype(float), want[b].astype(float), equal_nan=True, atol=1e-12), a
    assert got["alarm_high"].tolist() == want["cusum_alarm_high"].tolist() and got["alarm_low"].tolist() == want["cusum_alarm_low"].tolist()
    assert np.allclose(np.stack(got["probs"]), want[["prob_calm", "prob_elevated", "prob_stress"]].to_numpy(float), atol=1e-12)
    assert got["sigma"].isna().sum() > 0


def test_bars_without_parameters_and_forgotten_state(spark, walked, tmp_path):
    df, refits, want, c = walked
    bars = SR.bar_rows(df.where("rn between 300 and 309"), c)
    first = SR.parameter_rows(df, refits.where("refit_idx = 0"), c)
    early = SR.bar_rows(df.where("rn between 290 and 294"), c)

    class Later(list):  # the state of the second step has run out when the third begins
        def __iter__(self):
            for i, x in enumerate(list.__iter__(self)):
                time.sleep(4 if i == 2 else 0)
                yield x

    got = _play(spark, str(tmp_path), "out", Later([early, first, bars]), ttl_days=2.0 / 86_400)
    assert len(got) == 15 and got["sigma"].isna().all() and got["refit_idx"].isna().all()
    kept = _play(spark, str(tmp_path / "b"), "out", [early, first, bars])
    assert kept["refit_idx"].isna().sum() == 5 and np.allclose(kept["sigma"][5:].astype(float), want["conditional_vol"][:10].astype(float), equal_nan=True)
