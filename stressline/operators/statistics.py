"""Time-series statistics: the data-sized part is a Spark aggregate or one Arrow group a series, the rest is scalar."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressline.functions import dist
from stressline.functions.columns import by_symbol, ratio
from stressline.models import estimators as E


def series_summary(df: DataFrame, value: str) -> DataFrame:
    c = F.col(value)
    return df.groupBy("symbol").agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("excess_kurtosis")
    )


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    """Statistic and p-value (two degrees of freedom) from population moments."""
    m = df.groupBy("symbol").agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("excess_kurtosis", F.lit(2)) / 4)
    return m.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))


def autocorrelations(df: DataFrame, value: str, lags: int = 25) -> DataFrame:
    """symbol, lag, acf: all lags from one window pass and one aggregate; rows without a value are left out."""
    rows = df.where(F.col(value).isNotNull()).select("symbol", "date", F.col(value).alias("v"))
    rows = rows.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("symbol")))
    w = by_symbol()
    pairs = rows.select("symbol", "d", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)))
    sums = pairs.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s0"), *(F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    parts = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.col("s0")).alias("acf")) for k in range(1, lags + 1)))
    return sums.select("symbol", "n", F.explode(parts).alias("_p")).select("symbol", "n", "_p.lag", "_p.acf")


def acf_bands(acf: DataFrame) -> DataFrame:
    band = 1.96 / F.sqrt("n")
    return acf.withColumns({"band": band, "outside": F.abs("acf") > band})


def ljung_box(acf: DataFrame, lags: Sequence[int] = (10, 20)) -> DataFrame:
    """symbol, lag, q and its chi-square p-value."""
    n = F.col("n").cast("double")
    term = F.pow("acf", F.lit(2)) / (n - F.col("lag"))
    q = F.array(*(F.struct(F.lit(m).alias("lag"), (F.first("n") * (F.first("n") + 2) * F.sum(F.when(F.col("lag") <= m, term))).alias("q")) for m in lags))
    out = acf.groupBy("symbol").agg(q.alias("_q")).select("symbol", F.explode("_q").alias("_p")).select("symbol", "_p.lag", "_p.q")

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([dist.chi2_sf(a, b) for a, b in zip(x, k, strict=True)])

    return out.withColumn("p_value", tail("q", "lag"))


def durbin_levinson(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations 1 .. m."""
    m = len(acf)
    out, phi = np.zeros(m), np.zeros(0)
    for k in range(m):
        num = acf[k] - (phi @ acf[:k][::-1] if k else 0.0)
        den = 1 - (phi @ acf[:k] if k else 0.0)
        last = num / den if abs(den) > 1e-15 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def partial_autocorrelations(df: DataFrame, value: str, lags: int = 25) -> DataFrame:
    """Yule-Walker partial autocorrelations with the adjusted covariances (divisor n - k)."""
    acf = autocorrelations(df, value, lags).withColumn("acf", F.col("acf") * F.col("n") / (F.col("n") - F.col("lag")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pd.DataFrame({"symbol": pdf["symbol"], "lag": pdf["lag"], "pacf": durbin_levinson(pdf["acf"].to_numpy())})

    return acf.groupBy("symbol").applyInPandas(solve, "symbol string, lag int, pacf double")


def _design(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    y = x[lags:]
    return y, np.column_stack([np.ones(len(y)), *(x[lags - k : len(x) - k] for k in range(1, lags + 1))])


def arch_lm_series(x: np.ndarray, lags: int = 12) -> dict:
    """Engle's test: n R-squared and F of squared values on their lags."""
    e2 = (x[~np.isnan(x)]) ** 2
    y, a = _design(e2, lags)
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    rss, tss = float(((y - a @ b) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
    r2 = 1 - rss / tss if tss > 0 else 0.0
    n = len(y)
    f = (r2 / lags) / max((1 - r2) / (n - lags - 1), 1e-300)
    f_p = dist.beta_cdf((n - lags - 1) / (n - lags - 1 + lags * f), (n - lags - 1) / 2, lags / 2)
    return {"lm": n * r2, "lm_p": dist.chi2_sf(n * r2, lags), "f": f, "f_p": f_p}


#: MacKinnon's response surface of unit-root p-values for one series. star: where the small-p polynomial ends.
MACKINNON = {
    "c": {"min": -18.83, "star": -1.61, "max": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    "ct": {"min": -16.18, "star": -2.89, "max": 0.70, "small": (3.2512, 1.6047, 0.049588), "large": (2.5261, 0.61654, -0.37956, -0.060285)},
}
#: Critical values of the KPSS statistic at p = .10, .05, .025, .01.
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def mackinnon_p(stat: float, trend: str) -> float:
    m = MACKINNON[trend]
    if stat > m["max"]:
        return 1.0
    if stat < m["min"]:
        return 0.0
    return dist.norm_cdf(sum(c * stat**i for i, c in enumerate(m["small"] if stat <= m["star"] else m["large"])))


def adf(x: np.ndarray, trend: str = "c") -> dict:
    """Augmented Dickey-Fuller test, lag by AIC over a common sample, then refitted on all rows."""
    x = x[~np.isnan(x)]
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 1 - len(trend))
    dx = np.diff(x)

    def fit(lags: int, drop: int) -> tuple[float, float]:
        y = dx[drop:]
        cols = [x[drop:-1], np.ones(len(y)), *([np.arange(1, len(y) + 1)] if trend == "ct" else []), *(dx[drop - k : len(dx) - k] for k in range(1, lags + 1))]
        a = np.column_stack(cols)
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        s2 = float(e @ e) / (len(y) - a.shape[1])
        se = math.sqrt(s2 * np.linalg.pinv(a.T @ a)[0, 0])
        ll = -len(y) / 2 * (math.log(2 * math.pi * float(e @ e) / len(y)) + 1)
        return b[0] / se, 2 * a.shape[1] - 2 * ll

    lags = min(range(most + 1), key=lambda k: fit(k, most)[1])
    stat = fit(lags, lags)[0]
    return {"stat": float(stat), "p_value": mackinnon_p(stat, trend), "lags": lags}


def kpss(x: np.ndarray, trend: str = "c") -> dict:
    """KPSS test with the data-driven bandwidth; p-values stop at the ends of the table."""
    x = x[~np.isnan(x)]
    n = len(x)
    a = np.column_stack([np.ones(n), *([np.arange(1, n + 1)] if trend == "ct" else [])])
    e = x - a @ np.linalg.lstsq(a, x, rcond=None)[0]
    cov = lambda k: float(e[k:] @ e[: n - k]) / n
    few = int(n ** (2 / 9))
    s0, s1 = cov(0), 0.0
    for k in range(1, few + 1):
        s0 += 2 * cov(k)
        s1 += 2 * k * cov(k)
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s2 = cov(0) + 2 * sum((1 - k / (lags + 1)) * cov(k) for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * s2))
    return {"stat": stat, "p_value": float(np.interp(stat, KPSS_CRITICAL[trend], KPSS_P)), "lags": lags}


def stationarity_verdict(adf_p: Column, kpss_p: Column, level: float = 0.05) -> Column:
    a, k = adf_p < level, kpss_p < level
    # The verdicts' names.
    return (
        F.when(a & ~k, "Stationary").when(~a & k, "Unit Root").when(a & k, "Inconclusive (Both Reject)").otherwise("Inconclusive (Neither Rejects)")
    )


def stationarity(df: DataFrame, value: str) -> DataFrame:
    """symbol, trend, both tests and the verdict; one Arrow group a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["v"].to_numpy(float)
        out = []
        for trend in ("c", "ct"):
            a, k = adf(x, trend), kpss(x, trend)
            out.append((pdf["symbol"].iloc[0], trend, int((~np.isnan(x)).sum()), a["stat"], a["p_value"], a["lags"], k["stat"], k["p_value"], k["lags"]))
        return pd.DataFrame(out, columns=["symbol", "trend", "n", "adf_stat", "adf_p", "adf_lags", "kpss_stat", "kpss_p", "kpss_lags"])

    kind = "symbol string, trend string, n long, adf_stat double, adf_p double, adf_lags int, kpss_stat double, kpss_p double, kpss_lags int"
    tests = df.select("symbol", "date", F.col(value).cast("double").alias("v")).groupBy("symbol").applyInPandas(run, kind)
    return tests.withColumn("verdict", stationarity_verdict(F.col("adf_p"), F.col("kpss_p")))


def residual_diagnostics(df: DataFrame, value: str) -> DataFrame:
    """Degrees of freedom of a fitted Student t, and the ARCH test, a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["v"].to_numpy(float)
        x = x[~np.isnan(x)]
        return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], "student_df": E.fit_student_df(x), **arch_lm_series(x)}])

    kind = "symbol string, student_df double, lm double, lm_p double, f double, f_p double"
    return df.select("symbol", "date", F.col(value).cast("double").alias("v")).groupBy("symbol").applyInPandas(run, kind)


def qlike(realised: Column, forecast: Column) -> Column:
    r, f = F.greatest(realised, F.lit(1e-8)), F.greatest(forecast, F.lit(1e-8))
    return F.when(realised.isNotNull() & forecast.isNotNull(), r / f - F.ln(r / f) - 1)


def forecast_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE and direction hits over rows with both values; 0, 0 and .5 without any."""
    y, p = F.col(actual), F.col(predicted)
    both = y.isNotNull() & p.isNotNull()
    d = F.when(both, y - p)
    return df.groupBy("symbol").agg(
        F.count(d).alias("n"),
        F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.avg(F.abs(d)), F.lit(0.0)).alias("mae"),
        F.coalesce(F.avg(F.when(both, (F.sign(y) == F.sign(p)).cast("double"))), F.lit(0.5)).alias("dir_acc"),
    )


def diebold_mariano(df: DataFrame, error_a: str, error_b: str, h: int = 1) -> DataFrame:
    """Corrected statistic and p-value of equal squared errors, a series."""
    rows = df.withColumn("_d", F.pow(error_a, F.lit(2)) - F.pow(error_b, F.lit(2))).where("_d is not null")
    w = by_symbol()
    rows = rows.withColumn("_c", F.col("_d") - F.avg("_d").over(Window.partitionBy("symbol")))
    lags = [F.avg(F.col("_c") * F.col(f"_c{k}")).alias(f"_g{k}") for k in range(1, h)]
    rows = rows.withColumns({f"_c{k}": F.lag("_c", k).over(w) for k in range(1, h)}) if h > 1 else rows
    g = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("_d").alias("mean_diff"), F.avg(F.col("_c") * F.col("_c")).alias("_g0"), *lags)
    var = (F.col("_g0") + sum((2 * F.coalesce(f"_g{k}", F.lit(0.0)) for k in range(1, h)), F.lit(0.0))) / F.col("n")
    n = F.col("n").cast("double")
    factor = F.sqrt((n + 1 - 2 * h + h / n * (h - 1)) / n)
    neutral = (F.col("n") < 10) | (var <= 1e-12)
    g = g.withColumn("dm_stat", F.when(neutral, F.lit(0.0)).otherwise(F.col("mean_diff") / F.sqrt(var) * factor))
    g = g.withColumn("mean_diff", F.when(F.col("n") < 10, F.lit(0.0)).otherwise(F.col("mean_diff")))

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([1.0 if v == 0 else 2 * (1 - dist.t_cdf(abs(v), k - 1)) for v, k in zip(t, n, strict=True)])

    return g.select("symbol", "n", "mean_diff", "dm_stat", tail("dm_stat", "n").alias("p_value"))


def regime_statistics(df: DataFrame, regime: str, names: Sequence[str], *, ret: str = "return", drawdown: str = "drawdown") -> DataFrame:
    """Every regime, even an empty one: share of rows, annualised mean and volatility, shape, mean drawdown and 5 % quantile, in percent;
    moments are NULL up to five rows."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "regime int, regime_name string")
    grid = df.select("symbol").distinct().withColumn("regime", F.explode(F.array(*(F.lit(i) for i in range(len(names))))))
    r = F.col(ret)
    g = df.groupBy("symbol", F.col(regime).alias("regime")).agg(
        F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.skewness(r).alias("sk"), F.kurtosis(r).alias("ku"), F.avg(drawdown).alias("dd"), F.expr(f"percentile(`{ret}`, 0.05)").alias("q")
    )
    total = Window.partitionBy("symbol")
    out = grid.join(g, ["symbol", "regime"], "left").join(F.broadcast(dim), "regime").withColumn("n", F.coalesce("n", F.lit(0)))
    big = F.col("n") > 5
    pct = lambda c: F.round(F.when(big, c), 2)
    return out.select(
        "symbol", "regime", "regime_name", F.col("n").alias("days"), F.round(100 * ratio(F.col("n"), F.sum("n").over(total), 0), 2).alias("occupancy_pct"), pct(F.col("m") * 25200).alias("ann_mean_pct"),
        pct(F.col("s") * 100 * 252**0.5).alias("ann_vol_pct"), pct(F.col("sk")).alias("skew"), pct(F.col("ku")).alias("excess_kurtosis"), pct(F.col("dd") * 100).alias("mean_drawdown_pct"), pct(F.col("q") * 100).alias("var5_pct"),
    )


def value_shares(df: DataFrame, value: str) -> DataFrame:
    g = df.groupBy("symbol", F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))
