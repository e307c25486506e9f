"""Drawdown labels, crisis onsets and episodes, alarm spells, and early-warning evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stressline.functions.columns import by_symbol, ratio
from stressline.functions.prefix import running_totals
from stressline.sources.once import written_once


def label_events(df: DataFrame, *, h: int = 10, x: float = 0.05, price: str = "close") -> DataFrame:
    """rn, fwd_min_ret (the lowest price of the next h rows against this one) and event_label; the last h rows have no event.

    The only frame that looks ahead: a label, never a feature."""
    w = by_symbol()
    ahead = F.min(price).over(w.rowsBetween(1, h)) / F.col(price) - 1
    rn = F.row_number().over(w) - 1
    left = F.count("*").over(Window.partitionBy("symbol")) - rn
    label = F.when((left > h) & (ahead <= -x), 1).otherwise(0)
    return df.withColumns({"rn": rn, "fwd_min_ret": ahead, "event_label": label})


def scan_onsets(labels: np.ndarray, refractory: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy onsets and the episode of every labelled row: an onset opens an episode and bars the next ``refractory`` - 1 rows."""
    onset, episode = np.zeros(len(labels), bool), np.full(len(labels), -1, np.int64)
    free_at, current = -1, -1
    for i in np.flatnonzero(labels):
        if i >= free_at:
            current += 1
            onset[i] = True
            free_at = i + refractory
        episode[i] = current
    return onset, episode


def crisis_onsets(labelled: DataFrame, *, refractory: int = 20) -> DataFrame:
    """Adds crisis_onset and episode_id (-1 outside). The scan depends on the last onset taken, so it runs per symbol."""

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rn")
        onset, episode = scan_onsets(rows["event_label"].to_numpy(), refractory)
        return rows.append_column("crisis_onset", pa.array(onset)).append_column("episode_id", pa.array(episode))

    # The group function carries all columns, so the input is read once and not joined with itself.
    kind = T.StructType([*labelled.schema.fields, T.StructField("crisis_onset", T.BooleanType()), T.StructField("episode_id", T.LongType())])
    return labelled.groupBy("symbol").applyInArrow(scan, kind)


def crisis_episodes(events: DataFrame, *, before: int = 5, after: int = 30, price: str = "close") -> DataFrame:
    """Peak (first highest of the rows from ``before`` ahead of the onset) and trough (first lowest of the ``after`` rows from it)."""
    w = by_symbol()
    first = lambda agg, lo, hi, sign: agg(F.struct(F.col(price).alias("p"), (sign * F.col("rn")).alias("r"), F.col("date").alias("d"))).over(w.rowsBetween(lo, hi))
    found = events.withColumns({"_peak": first(F.max, -before, 0, -1), "_trough": first(F.min, 0, after - 1, 1)}).where("crisis_onset")
    return found.select(
        "symbol", "episode_id", F.col("rn").alias("onset_rn"), F.col("date").alias("onset_date"), F.col("_peak.d").alias("peak_date"), F.col("_trough.d").alias("trough_date"),
        F.col("_peak.p").alias("peak_price"), F.col("_trough.p").alias("trough_price"), (F.col("_trough.p") / F.col("_peak.p") - 1).alias("max_drawdown"), F.datediff("_trough.d", "_peak.d").alias("duration_days"),
    )


def alarm_spells(df: DataFrame, alarm: str | Column, *, max_gap: int = 5, score: str | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Runs of alarms; gaps of up to ``max_gap`` quiet rows are bridged. The peak score is over the whole span. Needs rn."""
    alarm = F.col(alarm) if isinstance(alarm, str) else alarm
    w = Window.partitionBy(*keys).orderBy("rn")
    on = F.coalesce(alarm, F.lit(False))
    last_on = F.last(F.when(on, F.col("rn")), ignorenulls=True)
    df = df.withColumns({"_on": on, "_prev": last_on.over(w.rowsBetween(Window.unboundedPreceding, -1))})
    new = F.col("_on") & (F.col("_prev").isNull() | (F.col("rn") - F.col("_prev") - 1 > max_gap))
    df = df.withColumn("_spell", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("_spell >= 0")
    end = F.max(F.when(F.col("_on"), F.col("rn"))).over(Window.partitionBy(*keys, "_spell"))
    df = df.withColumn("_end", end).where("rn <= _end")
    out = df.groupBy(*keys, F.col("_spell").alias("spell_id")).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min("rn").alias("start_idx"), F.max("rn").alias("end_idx"), (F.max("rn") - F.min("rn") + 1).alias("duration_days"),
        (F.max(score) if score else F.lit(None).cast("double")).alias("peak_msi"),
    )
    return out


def match_leads(episodes: DataFrame, spells: DataFrame, *, min_lead: int = 1, max_lead: int = 30, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Episodes with the shortest lead of a spell that starts min_lead to max_lead rows earlier (NULL: missed).

    The range is cut into buckets of max_lead rows, so it is an equi-join on (keys, bucket) whatever the sizes."""
    size = max_lead + 1
    e = episodes.select(*keys, "episode_id", "onset_rn").withColumn("_b", F.explode(F.array(F.expr(f"onset_rn div {size}"), F.expr(f"onset_rn div {size} - 1"))))
    s = spells.select(*keys, "spell_id", "start_idx").withColumn("_b", F.expr(f"start_idx div {size}"))
    pairs = e.join(s, [*keys, "_b"]).withColumn("lead", F.col("onset_rn") - F.col("start_idx")).where(F.col("lead").between(min_lead, max_lead))
    return pairs.select(*keys, "episode_id", "spell_id", "lead")


def curve_areas(df: DataFrame, score: str, label: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """roc_auc (ties share their rank) and pr_auc (trapezoids of the precision-recall curve, ending at recall 0, precision 1);
    0.5 and 0 where a class is missing. A missing score counts as 0, as no alarm was raised there. Scores are grouped first, then summed from the highest
    down in two levels, so one key may hold most of the rows."""
    keys = list(keys)
    rows = df.where(F.col(label).isNotNull()).select(*keys, F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s"), F.col(label).alias("_y"))
    g = rows.groupBy(*keys, "_s").agg(F.sum("_y").cast("double").alias("_p"), F.count("*").cast("double").alias("_n"))
    g = running_totals(g, keys, "_s", ("_p", "_n"), descending=True)
    tp, seen = F.col("_p_upto"), F.col("_n_upto")
    tp0, seen0 = tp - F.col("_p"), seen - F.col("_n")
    fp, fp0 = seen - tp, seen0 - tp0
    before = F.coalesce(F.try_divide(tp0, seen0), F.lit(1.0))
    areas = g.groupBy(*keys).agg(
        F.sum((tp + tp0) / 2 * (fp - fp0)).alias("_roc"), F.sum((tp / seen + before) / 2 * (tp - tp0)).alias("_pr"), F.max("_p_all").alias("_P"), F.max("_n_all").alias("_N")
    )
    both = (F.col("_P") > 0) & (F.col("_P") < F.col("_N"))
    return areas.select(
        *keys, F.when(both, F.try_divide("_roc", F.col("_P") * (F.col("_N") - F.col("_P")))).otherwise(0.5).alias("roc_auc"), F.when(both, F.try_divide("_pr", "_P")).otherwise(0.0).alias("pr_auc")
    )


def evaluate_alarms(df: DataFrame, alarm: str, score: str, *, max_gap: int = 5, max_lead: int = 30, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row a key: episode recall, spell precision, F1, lead times (0 where nothing was led), row confusion and curve areas over
    all rows, where a missing score counts as 0.

    df needs rn, event_label, crisis_onset, episode_id, the alarm and the score; rn counts rows of df. Five plans read df, so its columns are written once."""
    keys = list(keys)
    df = written_once(df.select(*keys, "date", "rn", "event_label", "crisis_onset", "episode_id", F.col(alarm).alias("_alarm"), F.col(score).cast("double").alias("_score")), "alarms")
    alarm, score = "_alarm", "_score"
    spells = alarm_spells(df, alarm, max_gap=max_gap, score=score, keys=keys)
    episodes = df.where("crisis_onset").select(*keys, "episode_id", F.col("rn").alias("onset_rn"))
    pairs = match_leads(episodes, spells, max_lead=max_lead, keys=keys)
    led = pairs.groupBy(*keys, "episode_id").agg(F.min("lead").alias("lead"))
    hit = pairs.select(*keys, "spell_id").distinct().groupBy(*keys).agg(F.count("*").alias("_good"))
    lead = led.groupBy(*keys).agg(
        F.count("*").alias("detected"), F.avg("lead").alias("mean_lead"), F.expr("percentile(lead, 0.5)").alias("median_lead"), (F.expr("percentile(lead, 0.75)") - F.expr("percentile(lead, 0.25)")).alias("iqr_lead")
    )
    on, y = F.coalesce(F.col(alarm), F.lit(False)), F.col("event_label") == 1
    rows = df.groupBy(*keys).agg(F.count_if(on & y).alias("tp"), F.count_if(on & ~y).alias("fp"), F.count_if(~on & ~y).alias("tn"), F.count_if(~on & y).alias("fn"), F.count_if("crisis_onset").alias("episodes"))
    n_spells = spells.groupBy(*keys).agg(F.count("*").alias("spells"))
    out = rows.join(n_spells, keys, "left").join(hit, keys, "left").join(lead, keys, "left").join(curve_areas(df, score, "event_label", keys), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    recall, precision = ratio(zero("detected"), F.col("episodes"), 0), ratio(zero("_good"), zero("spells"), 0)
    return out.select(
        *keys, "episodes", zero("spells").alias("spells"), zero("detected").alias("detected"), recall.alias("episode_recall"), precision.alias("spell_precision"), ratio(2 * recall * precision, recall + precision, 0).alias("f1"),
        *(zero(c).alias(c) for c in ("mean_lead", "median_lead", "iqr_lead")), "tp", "fp", "tn", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0).alias("daily_precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0).alias("daily_recall"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn"), 0).alias("false_alarm_rate"), F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"), F.coalesce("pr_auc", F.lit(0.0)).alias("pr_auc"),
    )


def compare_baselines(df: DataFrame, *, msi: str = "msi_headline", vix: str | None = None, vol: str = "rv_20", drawdown: str = "drawdown_252", max_gap: int = 5) -> DataFrame:
    """One row a model: the index against volatility, drawdown and level rules, evaluated in one pass over a long table.

    The volatility threshold is the 90th percentile of the evaluated slice. Without ``vix`` the level scores 0 everywhere and never alarms."""
    df = df.withColumn("_cut", F.percentile(vol, F.lit(0.9)).over(Window.partitionBy("symbol")))
    level = F.col(vix) if vix else F.lit(0.0)
    models = [("Stress index", F.col(msi) >= 50, F.col(msi)), ("Realised volatility", F.col(vol) >= F.col("_cut"), F.col(vol)), ("Drawdown", F.col(drawdown) <= -0.05, -F.col(drawdown)), ("Level", level >= 24, level)]
    parts = F.array(*(F.struct(F.lit(n).alias("model"), a.alias("alarm"), s.cast("double").alias("score")) for n, a, s in models))
    long = df.select("symbol", "date", "rn", "event_label", "crisis_onset", "episode_id", F.explode(parts).alias("_m")).select("symbol", "date", "rn", "event_label", "crisis_onset", "episode_id", "_m.*")
    return evaluate_alarms(long, "alarm", "score", max_gap=max_gap, keys=("symbol", "model"))


def block_bootstrap(df: DataFrame, score: str, label: str, *, metric: str = "pr_auc", resamples: int = 1000, block: int = 20, seed: int = 42, tasks: int = 8) -> DataFrame:
    """Moving-block percentile interval of the precision-recall or ROC area of each symbol; resamples are dealt over tasks, each with its own
    generator, so the result does not depend on where they run. Needs rn; fewer than 50 valid resamples give the point."""
    if metric not in ("pr_auc", "roc_auc"):
        raise ValueError(f"unknown metric {metric}")
    measure = precision_recall_area if metric == "pr_auc" else area
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select("symbol", "rn", F.col(score).alias("s"), F.col(label).alias("y"))
    per = -(-resamples // tasks)
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        s, y, chunk = pdf["s"].to_numpy(float), pdf["y"].to_numpy(int), int(pdf["chunk"].iloc[0])
        rng = np.random.default_rng([seed, chunk])
        n, out = len(s), []
        width = min(block, n)
        for _ in range(max(0, min(per, resamples - chunk * per))):
            starts = rng.integers(0, n - width + 1, -(-n // width))
            at = (starts[:, None] + np.arange(width)).ravel()[:n]
            out.append(measure(s[at], y[at]))
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "auc": out or [None]})

    boot = dealt.groupBy("symbol", "chunk").applyInPandas(run, "symbol string, auc double").where("auc is not null and not isnan(auc)")
    ci = boot.groupBy("symbol").agg(F.count("*").alias("valid"), F.expr("percentile(auc, 0.025)").alias("lo"), F.expr("percentile(auc, 0.975)").alias("hi"))
    point = curve_areas(rows, "s", "y").select("symbol", F.col(metric).alias("point"))
    few = F.coalesce("valid", F.lit(0)) < 50
    return point.join(ci, "symbol", "left").select("symbol", "point", F.when(few, F.col("point")).otherwise(F.col("lo")).alias("lower"), F.when(few, F.col("point")).otherwise(F.col("hi")).alias("upper"), F.coalesce("valid", F.lit(0)).alias("valid"))


def precision_recall_area(s: np.ndarray, y: np.ndarray) -> float:
    """Trapezoids under precision over recall at every distinct score, from recall 0 and precision 1 on; NaN where a class is missing."""
    pos = int(y.sum())
    if pos in (0, len(y)):
        return float("nan")
    order = np.argsort(-s, kind="stable")
    last = np.append(np.flatnonzero(np.diff(s[order])), len(s) - 1)
    hits = np.cumsum(y[order])[last]
    recall, precision = np.append(0.0, hits / pos), np.append(1.0, hits / (last + 1))
    return float(((precision[1:] + precision[:-1]) / 2 * np.diff(recall)).sum())


def area(s: np.ndarray, y: np.ndarray) -> float:
    """ROC area by ranks; NaN where a class is missing."""
    pos = int(y.sum())
    if pos in (0, len(y)):
        return float("nan")
    order = np.argsort(s, kind="stable")
    _, first, count = np.unique(s[order], return_index=True, return_counts=True)
    rank = np.empty(len(s))
    rank[order] = np.repeat(first + (count + 1) / 2, count)
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))
