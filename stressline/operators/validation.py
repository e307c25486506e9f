"""Checks that flag rows and profile series; nothing is repaired or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stressline.functions.columns import by_symbol, ratio

RULES = {
    "close_not_positive": "close <= 0",
    "high_below_body": "high < greatest(open, close) - 1e-6",
    "low_above_body": "low > least(open, close) + 1e-6",
    "low_not_positive": "low <= 0",
}


def validate_ohlc(bars: DataFrame) -> DataFrame:
    """valid_ohlc; a missing price violates no rule."""
    bad = F.lit(False)
    for rule in RULES.values():
        bad = bad | F.coalesce(F.expr(rule), F.lit(False))
    return bars.withColumn("valid_ohlc", ~bad)


def ohlc_violations(bars: DataFrame, examples: int = 5) -> DataFrame:
    """symbol, rule, violations and the first dates of each."""
    flags = F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()))
    rows = bars.select("symbol", "date", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("rule"))
    nth = F.row_number().over(by_symbol().partitionBy("symbol", "rule"))
    return rows.withColumn("_n", nth).groupBy("symbol", "rule").agg(F.count("*").alias("violations"), F.sort_array(F.collect_list(F.when(F.col("_n") <= examples, F.col("date")))).alias("dates"))


def quality_profile(bars: DataFrame, *, large_move: float = 0.10, gap_days: int = 4) -> DataFrame:
    """One row a symbol: rows, dates, repeated dates, large moves, volume coverage, calendar gaps."""
    w = by_symbol()
    df = bars.withColumns({"_ret": F.ln("close") - F.lag(F.ln("close")).over(w), "_gap": F.datediff("date", F.lag("date").over(w))})
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        (F.count("*") - F.count_distinct("date")).alias("duplicate_dates"),
        F.count_if(F.abs("_ret") > large_move).alias("large_moves"),
        F.round(100 * ratio(F.count_if(F.col("volume") > 0), F.count("*")), 2).alias("volume_coverage_pct"),
        F.count_if(F.col("_gap") > gap_days).alias("gaps"),
        F.max("_gap").alias("longest_gap_days"),
    )


def large_moves(bars: DataFrame, *, large_move: float = 0.10) -> DataFrame:
    """symbol, date and return in percent of every log return beyond the limit."""
    ret = F.ln("close") - F.lag(F.ln("close")).over(by_symbol())
    return bars.withColumn("_ret", ret).where(F.abs("_ret") > large_move).select("symbol", "date", (F.col("_ret") * 100).alias("return_pct"))


def volume_usable(bars: DataFrame, least: float = 0.90) -> DataFrame:
    """symbol, use_volume: whether enough rows have a positive volume."""
    return bars.groupBy("symbol").agg((ratio(F.count_if(F.col("volume") > 0), F.count("*")) >= least).alias("use_volume"))


def top_k(df: DataFrame, score: str, k: int, tie: str = "date") -> DataFrame:
    """The k rows with the highest score; ties by ``tie``."""
    return df.orderBy(F.desc(score), tie).limit(k)
