"""Recursive filters with fixed parameters, batch side: one Arrow group a series over the shared kernels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stressline.functions import recursions as R


def _nulls(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.isnan(n), F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def garch_filter(df: DataFrame, p: Mapping[str, float], *, ret: str = "return_pct") -> DataFrame:
    """symbol, date, sigma, z: sigma of a row depends on earlier rows only."""
    params = dict(p)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        _, sigma, z = R.garch_filter(R.GarchState(), pdf["r"].to_numpy(float), params, params["start"])
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], "sigma": sigma, "z": z})

    return _nulls(df.select("symbol", "date", F.col(ret).alias("r")).groupBy("symbol").applyInPandas(run, "symbol string, date date, sigma double, z double"))


def garch_forecasts(filtered: DataFrame, p: Mapping[str, float], horizon: int = 10) -> DataFrame:
    """One- to ``horizon``-step variances from each filtered row, as columns."""
    e = F.col("z") * F.col("sigma")
    lean = F.when(e < 0, p.get("gamma", 0.0)).otherwise(0.0)
    first = p["omega"] + (p["alpha"] + lean) * e * e + p["beta"] * F.col("sigma") * F.col("sigma")
    total = p["alpha"] + p["beta"] + p.get("gamma", 0.0) / 2
    cols = {}
    for h in range(1, horizon + 1):
        k = total ** (h - 1)
        cols[f"var_{h}"] = first * k + p["omega"] * ((1 - k) / (1 - total) if total != 1 else h - 1)
    return filtered.withColumns(cols)


def ewma_volatility(df: DataFrame, *, ret: str = "return_pct", lam: float = 0.94) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], "ewma_vol": R.ewma_vol(pdf["r"].to_numpy(float), lam)})

    return _nulls(df.select("symbol", "date", F.col(ret).alias("r")).groupBy("symbol").applyInPandas(run, "symbol string, date date, ewma_vol double"))


CUSUM_SCHEMA = "symbol string, date date, alarm_high boolean, alarm_low boolean, s_pos double, s_neg double, days_since long"


def cusum(df: DataFrame, value: str, *, k: float = 0.5, h: float = 5.0, train_rows: int | None = None, mean: float | None = None, std: float | None = None) -> DataFrame:
    """Two-sided page test; calibrated on the first ``train_rows`` rows unless mean and std are given."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        z = pdf["v"].to_numpy(float)
        state = R.CusumState(mean, std) if mean is not None else R.cusum_calibrate(R.CusumState(), z[:train_rows])
        _, out = R.cusum(state, z, k, h)
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], **out})

    return df.select("symbol", "date", F.col(value).cast("double").alias("v")).groupBy("symbol").applyInPandas(run, CUSUM_SCHEMA)


def hmm_forward(df: DataFrame, features: Sequence[str], p: Mapping) -> DataFrame:
    """symbol, date, probs (filtered state probabilities), regime (first most likely state)."""
    params = {k: np.asarray(v, float) for k, v in p.items() if k in ("startprob", "transmat", "means", "covars")}
    names = [f"x{i}" for i in range(len(features))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        _, probs = R.hmm_filter(None, pdf[names].to_numpy(float), params)
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], "probs": [None if np.isnan(x[0]) else x.tolist() for x in probs]})

    cols = [F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]
    out = df.select("symbol", "date", *cols).groupBy("symbol").applyInPandas(run, "symbol string, date date, probs array<double>")
    return out.withColumn("regime", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


def stress_ahead(filtered: DataFrame, transmat: Sequence[Sequence[float]], horizons: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Probability of the last state some rows ahead: a constant weighted sum of the filtered probabilities."""
    cols = {}
    for h in horizons:
        ahead = np.linalg.matrix_power(np.asarray(transmat, float), h)[:, -1]
        cols[f"stress_{h}"] = sum((F.col("probs")[i] * float(w) for i, w in enumerate(ahead)), F.lit(0.0))
    return filtered.withColumns(cols)


def garch_summary_columns(df: DataFrame) -> DataFrame:
    """persistence, unconditional_variance and half_life from parameter columns; NULL where the variance has no mean."""
    total = F.col("alpha") + F.col("beta") + F.col("gamma") / 2
    stable = total < 1
    return df.withColumns({"persistence": total, "unconditional_variance": F.when(stable, F.col("omega") / (1 - total)), "half_life": F.when(stable, F.lit(-0.6931471805599453) / F.ln(total))})
