"""Report sinks: Markdown and JSON from small aggregates, and the tables behind the usual figures."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from stressline.functions.columns import ratio


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small DataFrame as a Markdown table; larger ones are refused rather than cut."""
    return _table(df.columns, _few(df, most))


def _few(df: DataFrame, most: int) -> list[Row]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows do not make a report table")
    return rows


def _table(columns: Sequence[str], rows: list[Row]) -> str:
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(text(v).replace("|", "\\|") for v in r) + " |" for r in rows)])


def with_notes(df: DataFrame, note: Callable[[Row], str | None], most: int = 1000) -> str:
    """A table and below it what its rows say, a line each."""
    rows = _few(df, most)
    notes = [f"- {x}" for r in rows if (x := note(r))]
    return "\n\n".join([_table(df.columns, rows), *(["\n".join(notes)] if notes else [])])


def stationarity_note(r: Row) -> str | None:
    said = {
        (True, False): "the unit root is rejected and stationarity is not: the series reverts to its level",
        (False, True): "stationarity is rejected and the unit root is not: the series wanders, so work with its differences",
        (True, True): "both are rejected, as breaks in level or heavy tails can bring about",
        (False, False): "neither is rejected: the series is too short or too noisy to tell",
    }
    return None if r["adf_p"] is None or r["kpss_p"] is None else f"{r['symbol']} ({r['trend']}): {said[r['adf_p'] < 0.05, r['kpss_p'] < 0.05]}."


def ljung_box_note(r: Row) -> str | None:
    if r["p_value"] is None:
        return None
    return f"{r['symbol']}, {r['lag']} lags: " + ("values depend on earlier ones at the 5 % level." if r["p_value"] < 0.05 else "no dependence shows at the 5 % level.")


def arch_note(r: Row) -> str | None:
    if r["lm_p"] is None:
        return None
    left = "variance still clusters in the residuals, so the volatility model is too small." if r["lm_p"] < 0.05 else "no clustering of variance is left in the residuals."
    return f"{r['symbol']}: {left}"


def write_report(path: str, title: str, sections: dict[str, DataFrame | str]) -> None:
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n\n".join(parts) + "\n")


def write_metrics(path: str, tables: dict[str, DataFrame], extra: dict | None = None) -> None:
    out = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump((extra or {}) | out, f, indent=2, default=str)


def precision_recall_points(df: DataFrame, score: str, label: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """threshold, precision and recall at every distinct score."""
    g = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum("_p").over(w)
    return g.select(*keys, "threshold", ratio(tp, F.sum("_n").over(w)).alias("precision"), ratio(tp, F.sum("_p").over(Window.partitionBy(*keys)), 0).alias("recall"))


def lead_histogram(leads: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Equal bins from the shortest to the longest lead: as many as leads, from 3 to 12; the last bin is closed."""
    w = Window.partitionBy(*keys)
    df = leads.select(*keys, "lead", F.least(F.lit(12), F.greatest(F.count("*").over(w), F.lit(3))).alias("bins"), F.min("lead").over(w).alias("lo"), F.max("lead").over(w).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(F.lit(1.0) / F.col("bins"))
    start = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    df = df.withColumn("bin", F.least(F.floor((F.col("lead") - start) / width), F.col("bins") - 1).cast("int"))
    return df.groupBy(*keys, "bin").agg(F.count("*").alias("episodes"))
