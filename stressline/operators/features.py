"""Causal rolling features. Frames never look ahead; every rolling value is NULL until its window is full."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressline.functions.columns import ANNUAL, bounded_fill, by_symbol, clip, guarded, rolling_std, sample_kurtosis, sample_skew


@dataclass(frozen=True)
class FeatureWindows:
    rv: tuple[int, ...] = (5, 20, 60)
    parkinson: int = 20
    downside: int = 20
    drawdown: int = 252
    momentum: tuple[int, ...] = (20, 60)
    short_return: int = 5
    sma_short: int = 50
    sma_long: int = 200
    vol_z: int = 252
    volume_z: int = 60
    shape: int = 60
    corr: int = 60
    level_change: int = 20
    annual: float = field(default=ANNUAL)


DEFAULT = FeatureWindows()


def with_row_number(df: DataFrame) -> DataFrame:
    """rn: 0-based position in the symbol's calendar."""
    return df.withColumn("rn", F.row_number().over(by_symbol()) - 1)


def add_returns(df: DataFrame, f: FeatureWindows = DEFAULT) -> DataFrame:
    w = by_symbol()
    df = df.withColumn("return", F.ln("close") - F.lag(F.ln("close")).over(w)).withColumn("return_pct", F.col("return") * 100)
    sums = {f"rolling_ret_{f.short_return}": f.short_return} | {f"momentum_{n}": n for n in f.momentum}
    return df.withColumns({name: guarded(F.sum, "return", n, w) for name, n in sums.items()})


def add_drawdowns(df: DataFrame, f: FeatureWindows = DEFAULT) -> DataFrame:
    w = by_symbol()
    return df.withColumns(
        {
            "drawdown": F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1,
            f"drawdown_{f.drawdown}": F.col("close") / guarded(F.max, "close", f.drawdown, w) - 1,
        }
    )


def add_volatility(df: DataFrame, f: FeatureWindows = DEFAULT) -> DataFrame:
    """Realised, range and downside volatility; high and low count only where the bar is consistent."""
    w = by_symbol()
    valid = F.coalesce(F.col("valid_ohlc"), F.lit(True)) if "valid_ohlc" in df.columns else F.lit(True)
    high_low = F.when(valid, F.col("high") / F.col("low"))
    df = df.withColumns({f"rv_{n}": rolling_std("return", n, w) * f.annual for n in f.rv})
    df = df.withColumns(
        {
            "ln_rv20": F.ln(clip("rv_20", 1e-6)),
            "vol_ratio_5_20": F.ln(clip(F.try_divide("rv_5", "rv_20"), 1e-6)),
            "parkinson_daily": F.pow(F.ln(clip(high_low, 1.0)), 2) / F.lit(4 * 0.6931471805599453),
            "_down": F.pow(clip("return", hi=0.0), 2),
        }
    )
    df = df.withColumns(
        {
            f"parkinson_{f.parkinson}": F.sqrt(guarded(F.avg, "parkinson_daily", f.parkinson, w)) * f.annual,
            "downside_semi_dev": F.sqrt(guarded(F.avg, "_down", f.downside, w)) * f.annual,
            f"skew_{f.shape}_descriptive": sample_skew("return", f.shape, w),
            f"kurt_{f.shape}_descriptive": sample_kurtosis("return", f.shape, w),
        }
    ).drop("_down")
    df = df.withColumn("ln_parkinson", F.ln(clip(f"parkinson_{f.parkinson}", 1e-6)))
    spread = clip(rolling_std("ln_rv20", f.vol_z, w), 1e-6)
    return df.withColumn(f"vol_zscore_{f.vol_z}", (F.col("ln_rv20") - guarded(F.avg, "ln_rv20", f.vol_z, w)) / spread)


def add_trend(df: DataFrame, f: FeatureWindows = DEFAULT, use_volume: bool = True) -> DataFrame:
    w = by_symbol()
    short, long = guarded(F.avg, "close", f.sma_short, w), guarded(F.avg, "close", f.sma_long, w)
    df = df.withColumns({f"ln_p_sma{f.sma_short}": F.ln(clip(F.col("close") / short, 1e-6)), f"ln_sma{f.sma_short}_sma{f.sma_long}": F.ln(clip(short / long, 1e-6))})
    if not use_volume:
        return df.withColumn(f"volume_z_{f.volume_z}", F.lit(None).cast("double"))
    df = df.withColumn("_lv", F.ln(F.when(F.col("volume") > 0, F.col("volume"))))
    z = (F.col("_lv") - guarded(F.avg, "_lv", f.volume_z, w)) / clip(rolling_std("_lv", f.volume_z, w), 1e-6)
    return df.withColumn(f"volume_z_{f.volume_z}", z).drop("_lv")


def build_features(bars: DataFrame, f: FeatureWindows = DEFAULT, use_volume: bool = True) -> DataFrame:
    """All single-series features over one exchange and one sort by (symbol, date)."""
    return add_trend(add_volatility(add_drawdowns(add_returns(with_row_number(bars), f), f), f), f, use_volume)


def align_to_calendar(master: DataFrame, secondary: DataFrame, columns: Sequence[str], *, lag: int = 0, limit: int = 3, prefix: str = "sec_") -> DataFrame:
    """Columns of a secondary series on the master's calendar: shifted ``lag`` rows on its own calendar, joined on the
    exact date, then carried forward ``limit`` rows at most. Master rows are never added or dropped: of several
    secondary rows of one date (two series, or a repeated date) the query fails, as none of them is the series meant."""
    own = Window.orderBy("date") if "symbol" not in secondary.columns else Window.partitionBy("symbol").orderBy("date")
    shifted = secondary.select("date", *((F.lag(c, lag).over(own) if lag else F.col(c)).alias(prefix + c) for c in columns))
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("the secondary series has several rows of one date")).cast("boolean")).otherwise(F.lit(True))
    shifted = shifted.groupBy("date").agg(one.alias("_one"), *(F.first(prefix + c).alias(prefix + c) for c in columns)).where("_one").drop("_one")
    joined = master.join(shifted, "date", "left")
    w = by_symbol()
    return joined.withColumns({prefix + c: bounded_fill(prefix + c, limit, w) for c in columns})


def asof_align(master: DataFrame, secondary: DataFrame, columns: Sequence[str], *, strict: bool = True, prefix: str = "sec_") -> DataFrame:
    """Latest secondary row before (strict) or up to each master date, whatever the calendars; by symbol.

    One union and one window: no range join, whatever the sizes."""
    empty = [F.lit(None).cast(secondary.schema[c].dataType) for c in columns]
    mine = master.select("symbol", "date", F.lit(0 if strict else 1).alias("_side"), *(e.alias("_" + c) for e, c in zip(empty, columns, strict=True)), F.struct(*master.columns).alias("_row"))
    theirs = secondary.select("symbol", "date", F.lit(1 if strict else 0).alias("_side"), *(F.col(c).alias("_" + c) for c in columns))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({prefix + c: F.last("_" + c, ignorenulls=True).over(w) for c in columns})
    return seen.where("_row is not null").select(*(F.col(f"_row.{c}").alias(c) for c in master.columns), *(prefix + c for c in columns))


def add_cross_asset(df: DataFrame, other_close: str, name: str, f: FeatureWindows = DEFAULT) -> DataFrame:
    """Rolling Pearson correlation of returns; the other return is taken after filling, so holidays count as no move."""
    w = by_symbol()
    df = df.withColumn("_r", F.ln(F.when(F.col(other_close) > 0, F.col(other_close))))
    df = df.withColumn("_r", F.col("_r") - F.lag("_r").over(w))
    both = F.when(F.col("_r").isNotNull() & F.col("return").isNotNull(), F.lit(1))
    frame = w.rowsBetween(-(f.corr - 1), 0)
    corr = F.when(F.count(both).over(frame) == f.corr, F.corr("return", "_r").over(frame))
    return df.withColumn(f"corr_{name}_{f.corr}", corr).drop("_r")


def add_level_change(df: DataFrame, level: str, name: str, f: FeatureWindows = DEFAULT) -> DataFrame:
    """A level with a floor and its log change over ``level_change`` rows."""
    df = df.withColumn(f"{name}_level", clip(level, 1e-3))
    ln = F.ln(f"{name}_level")
    return df.withColumn(f"{name}_change_{f.level_change}", ln - F.lag(ln, f.level_change).over(by_symbol()))
