"""Frozen-parameter filters over a stream whose parameters are replaced while its state lives.

Bars and parameter rows come as one stream keyed by symbol. A parameter row holds a refit's parameters and the filter states after its training rows; it replaces both the GARCH and the regime
state, as every refit filters its own prefix, while CUSUM keeps its sums and takes the new in-control statistics. So the stream over blocks of refits gives the numbers
of the batch, row by row. State is one value a symbol and is forgotten ``ttl_days`` after the symbol's last row. It needs the RocksDB state store (``use_state_store``).

Rows of a micro-batch are taken by date, parameters before bars; bars before the first parameters give missing values. Nulls are missing returns or features, as in the batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stressline.functions import recursions as R
from stressline.plans import slices as SL
from stressline.plans.walk_forward import WalkForwardConfig, regime_model

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000

INPUT = ("symbol", "date", "parameters", "return_pct", "features")
OUTPUT = "symbol string, date date, refit_idx int, sigma double, z double, probs array<double>, alarm_high boolean, alarm_low boolean, s_pos double, s_neg double, days_since long"


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed value state needs, and no batches without rows: with state that runs out by the clock there would always be another one, and
    a query over what is available now would never end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def bar_rows(panel: DataFrame, c: WalkForwardConfig) -> DataFrame:
    """Bars in the form of the stream."""
    return panel.select("symbol", "date", F.lit(None).cast("string").alias("parameters"), F.col("return_pct").cast("double").alias("return_pct"), F.array(*(F.col(x).cast("double") for x in c.hmm_features)).alias("features"))


def parameter_rows(panel: DataFrame, refits: DataFrame, c: WalkForwardConfig) -> DataFrame:
    """A row for each refit, dated with the first row of its block: its parameters, and the filters' states after the training rows."""
    slices = SL.slices_for(panel, refits.select("symbol").distinct().count())

    def run(rows: pd.DataFrame, _: int, fits: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in fits.itertuples(index=False):
            t, g = int(r.t_refit), {k: float(v) for k, v in dict(r.garch).items()}
            train = rows[rows["rn"] < t]
            garch, _, _ = R.garch_filter(R.GarchState(), train["return_pct"].to_numpy(float), g, g["start"])
            hmm = {k: v.tolist() for k, v in regime_model(r).items()}
            alpha, _ = R.hmm_filter(None, train[list(c.hmm_features)].to_numpy(float), hmm)
            held = {"refit_idx": int(r.refit_idx), "garch": g, "garch_state": R.as_dict(garch), "hmm": hmm, "alpha": None if alpha is None else alpha.tolist(), "cusum": [float(r.cusum_mean), float(r.cusum_std)], "k": c.cusum_k, "h": c.cusum_h}
            out.append((r.symbol, rows.loc[rows["rn"] == t, "date"].iloc[0], json.dumps(held)))
        return pd.DataFrame(out, columns=["symbol", "date", "parameters"])

    dealt = refits.withColumn("slice", F.col("refit_idx") % slices)
    rows = SL.by_slice(panel, ["date", "return_pct", *c.hmm_features], slices, run, "symbol string, date date, parameters string", beside=dealt)
    return rows.select("symbol", "date", "parameters", F.lit(None).cast("double").alias("return_pct"), F.lit(None).cast("array<double>").alias("features"))


class RefitFilter(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "json string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the interface's names
        batch = pd.concat(list(rows))
        batch["_bar"] = batch["parameters"].isna()
        batch = batch.sort_values(["date", "_bar"], kind="stable").reset_index(drop=True)
        held = json.loads(self.held.get()[0]) if self.held.exists() else {"cusum_state": R.as_dict(R.CusumState())}
        out, run = [], batch["_bar"].ne(batch["_bar"].shift()).cumsum()
        for _, part in batch.groupby(run, sort=True):
            if part["_bar"].iloc[0]:
                out.append(filter_rows(part, held))
            else:
                for text in part["parameters"]:
                    held = {"cusum_state": held["cusum_state"], **json.loads(text)}
                    held["cusum_state"]["mean"], held["cusum_state"]["std"] = held["cusum"]
        self.held.update((json.dumps(held),))
        if out:
            yield pd.concat(out)

    def close(self) -> None:
        pass


def filter_rows(rows: pd.DataFrame, held: dict) -> pd.DataFrame:
    """Filtered columns of some bars; ``held`` moves on."""
    n = len(rows)
    out = pd.DataFrame({"symbol": rows["symbol"].to_numpy(), "date": rows["date"].to_numpy(), "refit_idx": pd.array([held.get("refit_idx")] * n, "Int32")})
    if "garch" not in held:
        return out.assign(sigma=np.nan, z=np.nan, probs=[None] * n, alarm_high=False, alarm_low=False, s_pos=0.0, s_neg=0.0, days_since=0)
    ret = rows["return_pct"].to_numpy(float)
    state, sigma, z = R.garch_filter(R.GarchState(**held["garch_state"]), ret, held["garch"], held["garch"]["start"])
    alpha, probs = R.hmm_filter(None if held["alpha"] is None else np.array(held["alpha"]), np.array([[np.nan if v is None else v for v in x] for x in rows["features"]], float), held["hmm"])
    cusum, found = R.cusum(R.CusumState(**held["cusum_state"]), z, held["k"], held["h"])
    held |= {"garch_state": R.as_dict(state), "alpha": None if alpha is None else alpha.tolist(), "cusum_state": R.as_dict(cusum)}
    return out.assign(sigma=sigma, z=z, probs=[None if np.isnan(x[0]) else x.tolist() for x in probs], **found)


def filter_stream(rows: DataFrame, *, ttl_days: float = 90.0) -> DataFrame:
    """The filtered stream of ``bar_rows`` and ``parameter_rows`` in one; see OUTPUT."""
    rows = rows.select(*INPUT)
    out = rows.groupBy("symbol").transformWithStateInPandas(RefitFilter(int(ttl_days * DAY_MS)), OUTPUT, "append", "ProcessingTime")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("sigma", "z")})
