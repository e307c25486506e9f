"""Structured Streaming: bars from an event stream, and the recursive filters one row at a time with kept state.

The kernels are those of the batch operators, so both give the same numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stressline.functions import recursions as R


def stream_bars(events: DataFrame, *, symbol: str = "event_type", ts: str = "ts", value: str = "value", width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and volume of event-time windows; events later than the watermark are left out."""
    df = events.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v"))
    if df.isStreaming:
        df = df.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.groupBy("symbol", window.alias("w")).agg(
        F.min_by("v", F.struct("ts", "v")).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", F.struct("ts", "v")).alias("close"), F.count("*").alias("volume")
    ).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume")


def stream_sessions(events: DataFrame, *, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    df = events.select(F.col(user).alias("user_id"), F.col(ts).cast("timestamp").alias("ts"))
    if df.isStreaming:
        df = df.withWatermark("ts", late)
    return df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def _stateful(df: DataFrame, schema: str, step) -> DataFrame:
    """step(state dict or None, rows sorted by date) -> (state dict, result rows); a micro-batch's rows come sorted."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("date")
        held = json.loads(state.get[0]) if state.exists else None
        held, out = step(held, rows)
        state.update((json.dumps(held),))
        yield out

    return df.groupBy("symbol").applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def stream_cusum(df: DataFrame, value: str, *, mean: float, std: float, k: float = 0.5, h: float = 5.0) -> DataFrame:
    from stressline.operators.filters import CUSUM_SCHEMA

    def step(held: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        state = R.CusumState(**held) if held else R.CusumState(mean, std)
        state, out = R.cusum(state, rows["v"].to_numpy(float), k, h)
        return R.as_dict(state), pd.DataFrame({"symbol": rows["symbol"], "date": rows["date"], **out})

    return _stateful(df.select("symbol", "date", F.col(value).cast("double").alias("v")), CUSUM_SCHEMA, step)


def stream_garch(df: DataFrame, value: str, p: dict) -> DataFrame:
    def step(held: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        state = R.GarchState(**held) if held else R.GarchState()
        state, sigma, z = R.garch_filter(state, rows["v"].to_numpy(float), p, p["start"])
        return R.as_dict(state), pd.DataFrame({"symbol": rows["symbol"], "date": rows["date"], "sigma": sigma, "z": z})

    return _stateful(df.select("symbol", "date", F.col(value).cast("double").alias("v")), "symbol string, date date, sigma double, z double", step)


def stream_hmm(df: DataFrame, features: list[str], p: dict) -> DataFrame:
    params = {k: np.asarray(v, float) for k, v in p.items()}

    def step(held: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        alpha = np.array(held["alpha"]) if held and held["alpha"] else None
        alpha, probs = R.hmm_filter(alpha, rows[features].to_numpy(float), params)
        out = pd.DataFrame({"symbol": rows["symbol"], "date": rows["date"], "probs": [None if np.isnan(x[0]) else x.tolist() for x in probs]})
        return {"alpha": None if alpha is None else alpha.tolist()}, out

    return _stateful(df.select("symbol", "date", *features), "symbol string, date date, probs array<double>", step)
