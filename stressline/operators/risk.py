"""Value at Risk and Expected Shortfall columns, and the tests that judge them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stressline.functions import dist
from stressline.functions.columns import by_symbol, col
from stressline.functions.order_stats import rolling_tails

TRADING_DAYS = 250
#: Most exceptions a 250-day year of each light at the 1 % level, and p-value limits beyond it.
GREEN_EXCEPTIONS, YELLOW_EXCEPTIONS = 4.9, 9.9
GREEN_P, YELLOW_P = 0.05, 0.01


def rolling_tail_columns(df: DataFrame, levels: Sequence[float], *, ret: str, window: int, lag: int, strict_nulls: bool, names: Sequence[str], block: int = 4096) -> DataFrame:
    """df with a quantile and a tail mean for each level. A series is cut into blocks of rows, each with the window - 1 + lag rows before it, so it
    runs in several tasks; in a block a Fenwick tree over ranks holds the frame."""
    halo, least = window - 1 + lag, max(window // 2, 100)
    block = max(block, halo + 1)  # rows of a halo come from one block
    numbered = df.withColumns({"_rn": F.row_number().over(by_symbol()) - 1, "_loss": -F.col(ret).cast("double")})
    own = F.expr(f"_rn div {block}")
    blocks = F.when(F.col("_rn") % block >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = numbered.withColumn("_block", F.explode(blocks))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_rn")
        first = int(np.count_nonzero(t["_rn"].to_numpy() < t["_block"][0].as_py() * block))
        loss = t["_loss"].to_numpy(zero_copy_only=False).astype(float)
        out = rolling_tails(loss, levels, window, lag=lag, least=least, first=first)
        if strict_nulls:
            seen = np.concatenate([[0], np.cumsum(np.isnan(loss))])
            at = np.arange(first, len(loss)) - lag + 1
            missing = seen[np.maximum(at, 0)] - seen[np.maximum(at - window, 0)] > 0
            out[missing, 1::2] = np.nan
        t = t.slice(first).drop_columns(["_rn", "_loss", "_block"])
        for j, name in enumerate(names):
            t = t.append_column(name, pa.array(out[:, j], mask=np.isnan(out[:, j])))
        return t

    kind = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return dealt.groupBy("symbol", "_block").applyInArrow(run, kind)


def historical_var(df: DataFrame, q: float, *, ret: str = "return_pct", window: int = 750, lag: int = 0, strict_nulls: bool = False, suffix: str | None = None) -> DataFrame:
    """Rolling quantile of losses and the mean of losses from it on; the frame holds day t unless lag is 1.

    strict_nulls leaves the shortfall NULL while the frame holds a missing return."""
    tag = suffix or f"{round(q * 100)}"
    return rolling_tail_columns(df, (q,), ret=ret, window=window, lag=lag, strict_nulls=strict_nulls, names=(f"var_hs_{tag}", f"es_hs_{tag}"))


def historical_var_panel(df: DataFrame, levels: Sequence[float] = (0.95, 0.99), *, ret: str = "return_pct", window: int = 750, block: int = 4096) -> DataFrame:
    """symbol, date and the same columns for several levels at once."""
    names = [f"{m}_hs_{round(q * 100)}" for q in levels for m in ("var", "es")]
    return rolling_tail_columns(df.select("symbol", "date", F.col(ret).alias("_ret")), levels, ret="_ret", window=window, lag=0, strict_nulls=False, names=names, block=block).drop("_ret")


def normal_var_es(mu: Column | str, sigma: Column | str, q: float) -> tuple[Column, Column]:
    z = dist.norm_ppf(q)
    mu, sigma = col(mu), col(sigma)
    return -mu + sigma * z, -mu + sigma * (dist.norm_pdf(z) / (1 - q))


def student_constants(nu: float, q: float) -> tuple[float, float]:
    """Unit-variance quantile and shortfall of a Student t loss; nu is at least 2.1."""
    nu = max(nu, 2.1)
    t = dist.t_ppf(q, nu)
    scale = math.sqrt((nu - 2) / nu)
    return t * scale, scale * dist.t_pdf(t, nu) / (1 - q) * (nu + t * t) / (nu - 1)


def student_var_es(mu: Column | str, sigma: Column | str, nu: float, q: float) -> tuple[Column, Column]:
    z, e = student_constants(nu, q)
    mu, sigma = col(mu), col(sigma)
    var, es = -mu + sigma * z, -mu + sigma * e
    return var, F.when(es < var, var * 1.05).otherwise(es)


def evt_var_es(mu: Column | str, sigma: Column | str, z_q: Column | str, es_q: Column | str) -> tuple[Column, Column]:
    mu, sigma = col(mu), col(sigma)
    return -mu + sigma * col(z_q), -mu + sigma * col(es_q)


def gpd_quantile(u: Column, xi: Column, beta: Column, n: Column, n_u: Column, q: float) -> Column:
    """Peaks-over-threshold quantile, with the logarithmic branch for a vanishing shape."""
    p = F.greatest(n / n_u * (1 - q), F.lit(1e-6))
    return F.when(F.abs(xi) < 1e-6, u - beta * F.ln(p)).otherwise(u + beta / F.when(F.abs(xi) < 1e-6, F.lit(1.0)).otherwise(xi) * (F.pow(p, -xi) - 1))


def gpd_shortfall(z: Column, u: Column, xi: Column, beta: Column) -> Column:
    """Mean loss beyond the quantile for shapes below one; NULL from .999 on, where the mean is not finite."""
    es = (z + beta - xi * u) / F.when(xi < 0.999, 1 - xi)
    return F.when(es < z, z * 1.05).otherwise(es)


def mean_residual_life(df: DataFrame, loss: str, *, points: int = 50, lo: float = 0.70, hi: float = 0.98) -> DataFrame:
    """Mean excess over a grid of thresholds with its 95 % band; NULL at thresholds that ten losses or fewer exceed. Every grid point is returned.

    A loss is counted once, at the highest threshold below it; sums from the highest threshold down give the rest."""
    x = F.col("_x")
    rows = df.select("symbol", F.col(loss).cast("double").alias("_x")).where("_x is not null")
    ends = rows.groupBy("symbol").agg(F.percentile("_x", F.lit(lo)).alias("_lo"), F.percentile("_x", F.lit(hi)).alias("_hi"))
    rows = rows.join(ends, "symbol")
    at = lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / (points - 1)
    k = F.coalesce(F.floor(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (points - 1)), F.lit(points - 1))
    k = F.greatest(F.lit(0), F.least(F.lit(points - 1), k))
    rows = rows.withColumn("_k", k)
    near = F.when((F.col("_k") < points - 1) & (x > at(F.col("_k") + 1)), F.col("_k") + 1).when(x > at(F.col("_k")), F.col("_k")).otherwise(F.col("_k") - 1)
    rows = rows.withColumns({"point": near.cast("int"), "_d": x - F.col("_lo")}).where("point >= 0")
    sums = rows.groupBy("symbol", "_lo", "_hi", "point").agg(F.count("*").alias("n"), F.sum("_d").alias("d"), F.sum(F.col("_d") * F.col("_d")).alias("d2"))
    grid = ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    down = Window.partitionBy("symbol").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    got = grid.join(sums.drop("_lo", "_hi"), ["symbol", "point"], "left").select("symbol", "point", at(F.col("point")).alias("threshold"), "_lo", *(F.coalesce(F.sum(c).over(down), F.lit(0)).alias(c) for c in ("n", "d", "d2")))
    mean = F.when(F.col("n") > 10, F.col("d") / F.col("n") - (F.col("threshold") - F.col("_lo")))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("d2") - F.col("d") * F.col("d") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)))
    half = F.when(F.col("n") > 10, 1.96 * sd / F.sqrt("n"))
    return got.select("symbol", "point", "threshold", "n", mean.alias("mean_excess"), (mean - half).alias("lower"), (mean + half).alias("upper"))


def _xlog(n: Column, p: Column) -> Column:
    return F.when(n > 0, n * F.ln(p)).otherwise(F.lit(0.0))


def _chi1(lr: Column) -> Column:
    """Survival of chi-square with one degree, a column of a small table."""

    @F.pandas_udf("double")
    def sf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2)))

    return sf(lr)


def breach_counts(df: DataFrame, keys: Sequence[str], breach: str, order: str = "date") -> DataFrame:
    """n, x and the transitions n00 .. n11 of a breach flag; rows without a flag are left out."""
    df = df.where(F.col(breach).isNotNull())
    before = F.lag(breach).over(Window.partitionBy(*keys).orderBy(order))
    t = lambda a, b: F.count_if((F.col("_b") == a) & (F.col(breach) == b))
    return df.withColumn("_b", before).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(breach)).alias("x"), t(False, False).alias("n00"), t(False, True).alias("n01"), t(True, False).alias("n10"), t(True, True).alias("n11")
    )


def kupiec_lr(n: Column, x: Column, alpha: Column) -> Column:
    """Proportion-of-failures likelihood ratio."""
    p = x / n
    null = _xlog(n - x, 1 - alpha) + _xlog(x, alpha)
    alt = _xlog(n - x, 1 - p) + _xlog(x, p)
    return F.greatest(F.lit(0.0), -2 * (null - alt))


def christoffersen_lr() -> Column:
    """Independence likelihood ratio from n00 .. n11, probabilities kept off 0 and 1."""
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    bound = lambda p: F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), F.coalesce(p, F.lit(0.0))))
    p01, p11 = bound(F.try_divide(n01, n00 + n01)), bound(F.try_divide(n11, n10 + n11))
    p = bound(F.try_divide(n01 + n11, n00 + n01 + n10 + n11))
    null = (n00 + n10) * F.ln(1 - p) + (n01 + n11) * F.ln(p)
    alt = n00 * F.ln(1 - p01) + n01 * F.ln(p01) + n10 * F.ln(1 - p11) + n11 * F.ln(p11)
    return F.greatest(F.lit(0.0), -2 * (null - alt))


def coverage_tests(counts: DataFrame, alpha: Column) -> DataFrame:
    """Kupiec, Christoffersen and joint tests from breach_counts."""
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    df = counts.withColumn("kupiec_lr", kupiec_lr(n, x, alpha))
    df = df.withColumn("christoffersen_lr", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(christoffersen_lr()))
    df = df.withColumns({"kupiec_p": _chi1(F.col("kupiec_lr")), "christoffersen_p": F.when(F.col("n") < 2, F.lit(1.0)).otherwise(_chi1(F.col("christoffersen_lr")))})
    return df.withColumn("joint_cc_p", F.exp(-(F.col("kupiec_lr") + F.col("christoffersen_lr")) / 2))


def traffic_light(alpha: Column, rate: Column, kupiec_p: Column) -> Column:
    year = rate * TRADING_DAYS
    tail = F.when(year <= GREEN_EXCEPTIONS, "Green").when(year <= YELLOW_EXCEPTIONS, "Yellow").otherwise("Red")
    wide = F.when(kupiec_p >= GREEN_P, "Green").when(kupiec_p >= YELLOW_P, "Yellow").otherwise("Red")
    return F.when(alpha <= 0.02, tail).otherwise(wide)


def shortfall_bootstrap(pdf: pd.DataFrame, *, resamples: int = 2000, seed: int = 42) -> dict:
    """One-sided bootstrap of standardised excesses beyond the shortfall on breach days; fewer than five breaches pass."""
    e = ((pdf["loss"] - pdf["es"]) / pdf["sigma"].clip(lower=1e-4))[pdf["loss"] > pdf["var"]].to_numpy(float)
    if len(e) < 5:
        return {"n_breaches": len(e), "mean_excess": float(e.mean()) if len(e) else 0.0, "t_stat": 0.0, "es_p": 1.0, "es_reject": False}
    mean, sd = e.mean(), e.std(ddof=1)
    centred = e - mean
    rng = np.random.default_rng(seed)
    boot = centred[rng.integers(0, len(e), (resamples, len(e)))].mean(axis=1)
    p = float((boot >= mean).mean())
    return {"n_breaches": len(e), "mean_excess": float(mean), "t_stat": float(mean / (sd / math.sqrt(len(e)))) if sd > 1e-12 else 0.0, "es_p": p, "es_reject": p < 0.05}


def to_models(df: DataFrame, models: dict[str, tuple[str, str]], alpha: float, *, ret: str = "return_pct") -> DataFrame:
    """Long form: one row a (model, day) with loss, var and es; one pass over the data."""
    parts = [F.struct(F.lit(name).alias("model"), F.col(v).alias("var"), F.col(e).alias("es")) for name, (v, e) in models.items()]
    return df.select("symbol", "date", (-F.col(ret)).alias("loss"), F.lit(alpha).alias("alpha"), F.explode(F.array(*parts)).alias("_m")).select("symbol", "date", "loss", "alpha", "_m.model", "_m.var", "_m.es")


def var_scorecard(long: DataFrame, *, least: int = 20, sigma: str | None = None) -> DataFrame:
    """One row a (symbol, alpha, model) with rates, tests and traffic light; models with fewer than ``least`` days are left out."""
    keys = ["symbol", "alpha", "model"]
    days = long.where("loss is not null and var is not null").withColumn("breach", F.col("loss") > F.col("var"))
    days = days.withColumn("sigma", F.col(sigma) if sigma else F.lit(1.0))
    counts = coverage_tests(breach_counts(days, keys, "breach").where(F.col("n") >= least), F.col("alpha"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **{k: v for k, v in shortfall_bootstrap(pdf).items() if k in ("es_p", "mean_excess")}}])

    breaches = days.where("breach and es is not null")
    es = breaches.groupBy(*keys).applyInPandas(test, "symbol string, alpha double, model string, es_p double, mean_excess double")
    out = counts.join(es, keys, "left")
    rate = F.col("x") / F.col("n")
    return out.select(
        "symbol", "model", "alpha", (1 - F.col("alpha")).alias("confidence"), rate.alias("observed_rate"), F.col("x").alias("breaches"), F.col("n").alias("days"),
        "kupiec_lr", "kupiec_p", "christoffersen_lr", "christoffersen_p", "joint_cc_p", F.coalesce("es_p", F.lit(1.0)).alias("es_p"), traffic_light(F.col("alpha"), rate, F.col("kupiec_p")).alias("traffic_light"),
    )

