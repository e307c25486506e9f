import json

import pytest

from stressline.plans import config as C
from stressline.plans import reports as RP
from stressline.plans import run as RUN

from .test_features import panel


def test_config_hash_and_unknown_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("walk:\n  cadence: 50\nfeatures:\n  rv: [5, 20, 60]\n")
    c = C.load_config(str(f))
    assert c.walk.cadence == 50 and C.config_hash(c) == C.config_hash(C.load_config(str(f))) != C.config_hash(C.load_config())
    f.write_text("walk:\n  cadense: 50\n")
    with pytest.raises(ValueError):
        C.load_config(str(f))


def test_run_writes_tables_and_reports(spark, tmp_path):
    from pyspark.sql import functions as F

    bars = panel(spark, 500).withColumn("symbol", F.lit("IDX")).drop("valid_ohlc")
    bars = bars.unionByName(panel(spark, 500, 4).withColumn("symbol", F.lit("OTHER")).drop("valid_ohlc"))
    f = tmp_path / "c.yaml"
    f.write_text("data:\n  optional: [OTHER, ABSENT]\n  lags: {OTHER: 1}\nwalk:\n  initial_train: 400\n  cadence: 60\n  hmm_starts: 1\n  trees: 20\n  hs_window: 200\n  corr: corr_other_60\n")
    out = RUN.run(spark, bars, str(tmp_path / "out"), str(tmp_path), C.load_config(str(f)))
    assert out.oos.count() == 100
    assert "stress_band" not in (tmp_path / "data_quality.md").read_text() and "Tail risk" in (tmp_path / "results.md").read_text()
    said = (tmp_path / "diagnostics.md").read_text()
    assert "- IDX (" in said and "- IDX, 10 lags: " in said and said.count("clustering of variance") + said.count("variance still clusters") == 1
    assert len(json.loads((tmp_path / "metrics.json").read_text())["scorecard"]) == 8
    assert len(json.loads((tmp_path / "manifest.json").read_text())["config_sha256"]) == 64
    with pytest.raises(RuntimeError):
        RUN.prepare(bars.where("symbol = 'OTHER'"), C.load_config())


def test_notes_follow_the_tests():
    from pyspark.sql import Row

    at = lambda a, k: RP.stationarity_note(Row(symbol="S", trend="c", adf_p=a, kpss_p=k))
    assert len({at(a, k) for a in (0.01, 0.2) for k in (0.01, 0.2)}) == 4 and "reverts" in at(0.01, 0.1) and "differences" in at(0.5, 0.01) and at(None, 0.1) is None
    assert "no dependence" in RP.ljung_box_note(Row(symbol="S", lag=10, p_value=0.05)) and "depend on" in RP.ljung_box_note(Row(symbol="S", lag=10, p_value=0.049))
    assert RP.arch_note(Row(symbol="S", lm_p=None)) is None and "too small" in RP.arch_note(Row(symbol="S", lm_p=0.01))
