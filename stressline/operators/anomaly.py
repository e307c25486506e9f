"""One isolation forest over a whole panel: samples, trees and scores are all distributed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stressline.functions.prefix import running_totals
from stressline.models import estimators as E
from stressline.sources.once import written_once

TREE = "tree int, n int, feature array<int>, cut array<double>, left array<int>, value array<double>"


def bottom_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, trees: int, sample: int, seed: int) -> DataFrame:
    """tree and df's columns: for every tree the ``sample`` rows with the smallest hashes of (seed, tree, keys); a sample without replacement that does not depend on partitions.

    A row is a candidate of a tree where its hash lies in the lowest part that is expected to hold twice the sample (and 64 rows), so about trees x 2 x sample rows are
    shuffled, whatever the size of df."""
    rows = df.count()
    share = min(1.0, 2.0 * (sample + 64) / max(rows, 1))
    low = F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))
    draw = lambda t: F.xxhash64(F.lit(seed), t, *keys)
    near = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= low)
    dealt = df.withColumn("tree", F.explode(near))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(draw(F.col("tree")), *order))
    return dealt.withColumn("_place", place).where(F.col("_place") <= sample).drop("_place")


def fit_panel_forest(train: DataFrame, features: Sequence[str], keys: Sequence[str], *, trees: int = 300, sample: int = 256, seed: int = 42) -> dict:
    """An isolation forest from the complete rows of ``train``. The driver gets trees x (2 x sample) nodes at most."""
    features = list(features)
    full = train.select(*keys, *(F.col(f).cast("double").alias(f) for f in features)).where(complete(features))
    stats = full.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    k = range(len(features))
    if stats["m0"] is None:
        raise ValueError("no complete row to fit a forest to")
    mean, std = np.array([stats[f"m{i}"] for i in k]), np.array([stats[f"s{i}"] or 1.0 for i in k])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*features, *keys])
        tree = int(pdf["tree"].iloc[0])
        return pd.DataFrame([{"tree": tree, "n": len(pdf)} | {c: v.tolist() for c, v in E.grow_tree((pdf[features].to_numpy(float) - mean) / std, np.random.default_rng([seed, tree])).items()}])

    drawn = bottom_k(full, keys, features, trees=trees, sample=sample, seed=seed)
    grown = drawn.groupBy("tree").applyInPandas(grow, TREE).orderBy("tree").toPandas()
    return E.join_trees(grown.to_dict("records"), mean, std)


def complete(features: Sequence[str]) -> Column:
    out = F.lit(True)
    for f in features:
        out = out & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return out


def score_forest(df: DataFrame, model: dict, features: Sequence[str], name: str = "score") -> DataFrame:
    """df with each row's score; NULL where a feature is missing. The model is broadcast, nothing is grouped or shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], axis=1) if b.num_rows else np.zeros((0, len(features)))
            missing = np.isnan(x).any(axis=1)
            score = E.forest_score(shared.value, np.where(missing[:, None], 0.0, x)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, mask=missing)], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def panel_forest(df: DataFrame, features: Sequence[str], *, train: Column, keys: Sequence[str] = ("symbol", "date"), trees: int = 300, sample: int = 256, seed: int = 42, flag_from: float = 0.99) -> DataFrame:
    """keys, score, percentile (among the training rows' scores) and flag, one row an input row; rows with a missing feature have NULLs and are in no sample.

    One forest over all symbols, from the rows where ``train`` holds."""
    model = fit_panel_forest(df.where(train), features, keys, trees=trees, sample=sample, seed=seed)
    scored = written_once(score_forest(df.select(*keys, *(F.col(f).cast("double").alias(f) for f in features), F.coalesce(train, F.lit(False)).alias("_train")), model, features).drop(*features), "forest")
    counts = scored.where("score is not null").groupBy("score").agg(F.count_if("_train").alias("_t"))
    counts = running_totals(counts.withColumn("_one", F.lit(1)), ["_one"], "score", ["_t"]).select("score", (F.col("_t_upto") / F.col("_t_all")).alias("percentile"))
    return scored.join(counts, "score", "left").select(*keys, "score", "percentile", (F.col("percentile") >= flag_from).alias("flag"))
