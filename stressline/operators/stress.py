"""Composite stress index: components, weighting, bands, alarms and contributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressline.functions.columns import clip, row_mean
from stressline.functions.prefix import running_totals

COMPONENTS = ("c_hmm", "c_vol", "c_drawdown", "c_anomaly", "c_cross_asset")
#: Lower ends of the bands.
BANDS = (("Normal", 0.0), ("Elevated", 25.0), ("High Risk", 50.0), ("Severe", 75.0))
PRIMARY, SECONDARY = 50.0, 75.0


def ecdf_columns(df: DataFrame, specs: Mapping[str, str], train_rows: int, flags: bool = True) -> DataFrame:
    """For each {name: value}: the share of training values (rn < train_rows) up to this value, and whether it exceeds them all.

    Training counts are taken by value and summed over the sorted union of values in two levels, so nothing is held in one
    array and a symbol may hold most of the rows; without training values the share is 0 and the flag false."""
    for name, value in specs.items():
        v, train = F.col(value), F.col("rn") < train_rows
        counts = df.where(v.isNotNull()).groupBy("symbol", v.cast("double").alias("_v")).agg(F.count_if(train).alias("_t"))
        counts = running_totals(counts, ["symbol"], "_v", ["_t"])
        beyond = (F.col("_t") == 0) & (F.col("_t_upto") == F.col("_t_all")) & (F.col("_t_all") > 0)
        counts = counts.select(F.col("symbol").alias("_s"), "_v", F.col("_t_upto").alias("_le"), F.col("_t_all").alias("_n"), beyond.alias("_new"))
        df = df.join(counts, (F.col("symbol") == F.col("_s")) & (v == F.col("_v")), "left")
        share = F.coalesce(F.try_divide(F.col("_le").cast("double"), F.col("_n")), F.lit(0.0))
        new = {name: F.when(v.isNotNull(), share)}
        if flags:
            new[f"{name}_exceeds"] = F.when(v.isNotNull(), F.coalesce("_new", F.lit(False)))
        df = df.withColumns(new).drop("_s", "_v", "_le", "_n", "_new")
    return df


def build_components(df: DataFrame, train_rows: int, *, prob: str = "prob_stress", vol: str = "conditional_vol", drawdown: str = "drawdown_252", anomaly: str = "anomaly_percentile", corr: str | None = None) -> DataFrame:
    """Components between 0 and 1: probabilities and percentiles as they are, the others by their training distribution."""
    df = df.withColumns({"_dd": F.abs(drawdown), "c_hmm": clip(prob, 0.0, 1.0), "c_anomaly": clip(anomaly, 0.0, 1.0)})
    specs = {"c_vol": vol, "c_drawdown": "_dd"} | ({"c_cross_asset": corr} if corr else {})
    return ecdf_columns(df, specs, train_rows).drop("_dd")


def index_equal(cols: Sequence[str]) -> Column:
    return clip(row_mean(cols) * 100, 0.0, 100.0)


def index_weighted(cols: Sequence[str], weights: Mapping[str, float | Column]) -> Column:
    """Weights of the present columns, scaled to one; a column without a weight gets one over the number present."""
    present = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    w = {c: F.coalesce(weights[c] if isinstance(weights.get(c), Column) else F.lit(weights.get(c)).cast("double"), F.try_divide(F.lit(1.0), present)) for c in cols}
    num = sum((F.coalesce(F.col(c) * w[c], F.lit(0.0)) for c in cols), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), w[c]).otherwise(F.lit(0.0)) for c in cols), F.lit(0.0))
    return clip(F.try_divide(num, den) * 100, 0.0, 100.0)


def index_logit(cols: Sequence[str], coef: Sequence[float | Column], intercept: float | Column) -> Column:
    z = sum((F.col(c) * b for c, b in zip(cols, coef, strict=True)), F.lit(0.0)) + intercept
    return clip(F.lit(100.0) / (1 + F.exp(-z)), 0.0, 100.0)


def aggregate_index(cols: Sequence[str], method: str = "W-EQ", weights: Mapping | None = None, logit: tuple | None = None) -> Column:
    if method == "W-EQ" or (method == "W-LOGIT" and logit is None):
        return index_equal(cols)
    if method == "W-PCA":
        return index_weighted(cols, weights or {})
    if method == "W-LOGIT":
        return index_logit(cols, *logit)
    raise ValueError(f"unknown method {method}")


def band(index: Column | str) -> Column:
    """Names by lower ends; anything else, missing too, is Normal."""
    index = F.col(index) if isinstance(index, str) else index
    out = F.lit(BANDS[0][0])
    for name, lo in BANDS[1:]:
        out = F.when((index >= lo) & (index <= 100), F.lit(name)).otherwise(out)
    return out


def alarms(df: DataFrame, index: str, primary: float = PRIMARY, secondary: float = SECONDARY) -> DataFrame:
    return df.withColumns({"alarm_primary": F.col(index) >= primary, "alarm_secondary": F.col(index) >= secondary})


def contributions(df: DataFrame, cols: Sequence[str], weights: Mapping[str, float | Column] | None = None) -> DataFrame:
    """Parts of the index that add up to it (before it is clipped); NULL where the component is missing. With weights they are those of the weighted
    index: scaled to one over the columns present, one over their number for a column without a weight."""
    present = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    equal = F.try_divide(F.lit(1.0), present)
    if weights is None:
        return df.withColumns({f"contrib_{c.removeprefix('c_')}": F.try_divide(F.col(c) * 100, present) for c in cols})
    w = {c: F.coalesce(weights[c] if isinstance(weights.get(c), Column) else F.lit(weights.get(c)).cast("double"), equal) for c in cols}
    whole = sum((F.when(F.col(c).isNotNull(), w[c]).otherwise(F.lit(0.0)) for c in cols), F.lit(0.0))
    return df.withColumns({f"contrib_{c.removeprefix('c_')}": F.try_divide(F.col(c) * w[c] * 100, whole) for c in cols})
