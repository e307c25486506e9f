"""Walk-forward mean models: orders chosen anew every ``reselect`` rows, refitted every ``refit`` rows, against two baselines.

A block's forecast is the one made at its refit. Fits of all orders at all choices are dealt over slices of a series, then the refits with the chosen orders; a slice
holds the series once and cuts the prefixes of its fits. A series of ``initial`` rows or fewer is an error."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressline.models import arma as A
from stressline.operators import statistics as ST
from stressline.plans import slices as SL
from stressline.sources.once import written_once

FITS = "symbol string, t_select int, p int, q int, constant boolean, n_params int, bic double, forecast double"
REFITS = "symbol string, refit_idx int, t_refit int, t_next int, p int, q int, constant boolean, forecast double"


def chosen(fits: DataFrame, keys: list[str], within: float = 2.0) -> DataFrame:
    """Of each key's orders within ``within`` of the least BIC, the one with fewest parameters, then least BIC."""
    near = fits.withColumn("_least", F.min("bic").over(Window.partitionBy(*keys))).where(F.col("bic") <= F.col("_least") + within)
    best = near.groupBy(*keys).agg(F.min(F.struct("n_params", "bic", "p", "q", "constant", "forecast")).alias("b"))
    return best.select(*keys, "b.p", "b.q", "b.constant", "b.n_params", "b.bic", "b.forecast")


def order_fits(df: DataFrame, value: str, ends: list[int] | None = None, *, slices: int, p_max: int = 3, q_max: int = 3) -> DataFrame:
    """A fit of every order to every prefix (rn < end; the whole series where no ends are given), dealt over slices."""

    def run(rows: pd.DataFrame, k: int) -> pd.DataFrame:
        n = len(rows)
        tasks = [(t, *o) for t in ([n] if ends is None else [t for t in ends if t < n]) for o in A.orders(p_max, q_max)]
        out = []
        for t, p, q, c in tasks[k::slices]:
            f = A.fit_arma(rows.loc[rows["rn"] < t, "v"].dropna().to_numpy(float), p, q, c)
            out.append({"symbol": rows["symbol"].iloc[0], "t_select": t} | {x: f[x] for x in ("p", "q", "constant", "n_params", "bic", "forecast")})
        return pd.DataFrame(out, columns=[x.split()[0] for x in FITS.split(", ")])

    return SL.by_slice(df.withColumn("v", F.col(value).cast("double")), ["v"], slices, run, FITS)


def arma_walk_forward(df: DataFrame, value: str, *, initial: int = 1260, refit: int = 63, reselect: int = 252, p_max: int = 3, q_max: int = 3) -> DataFrame:
    """symbol, date, rn, actual, arma, zero, mean: out-of-sample one-step forecasts. Needs rn; rows without a value keep their place."""
    symbols, longest = SL.lengths(df, initial, "initial").agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    slices = SL.slices_for(df, symbols)
    df = df.withColumn("v", F.col(value).cast("double"))
    every = max(1, -(-reselect // refit)) * refit  # a choice is made at the first refit that is due
    ends = list(range(initial, longest or initial, every))
    picks = chosen(written_once(order_fits(df, "v", ends, slices=slices, p_max=p_max, q_max=q_max), "orders"), ["symbol", "t_select"])
    dealt = picks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def run(rows: pd.DataFrame, k: int, picked: pd.DataFrame) -> pd.DataFrame:
        n, out = len(rows), []
        order = {int(x.t_select): (int(x.p), int(x.q), bool(x.constant)) for x in picked.itertuples(index=False)}
        for i, t in list(enumerate(range(initial, n, refit)))[k::slices]:
            p, q, c = order[initial + (t - initial) // every * every]
            f = A.fit_arma(rows.loc[rows["rn"] < t, "v"].dropna().to_numpy(float), p, q, c)
            out.append((rows["symbol"].iloc[0], i, t, min(t + refit, n), p, q, c, f["forecast"]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in REFITS.split(", ")])

    fits = SL.by_slice(df, ["v"], slices, run, REFITS, beside=dealt)
    w = Window.partitionBy("symbol").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("symbol", "date", "rn", F.col("v").alias("actual"), F.avg("v").over(w).alias("mean")).where(F.col("rn") >= initial)
    rows = rows.withColumn("refit_idx", F.floor((F.col("rn") - initial) / refit).cast("int"))
    return rows.join(fits.select("symbol", "refit_idx", F.col("forecast").alias("arma")), ["symbol", "refit_idx"]).select("symbol", "date", "rn", "actual", "arma", F.lit(0.0).alias("zero"), "mean")


def compare(forecasts: DataFrame) -> DataFrame:
    """Errors of each model and whether they differ from the zero forecast's."""
    forecasts, out = written_once(forecasts, "forecasts"), None
    for name in ("arma", "zero", "mean"):
        m = ST.forecast_metrics(forecasts, "actual", name)
        d = ST.diebold_mariano(forecasts.withColumns({"_a": F.col("actual") - F.col(name), "_b": F.col("actual")}), "_a", "_b").select("symbol", "dm_stat", "p_value")
        part = m.join(d, "symbol", "left").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
