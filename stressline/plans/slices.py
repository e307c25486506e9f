"""Work on growing prefixes of a series: each slice of a series' tasks gets the rows once and cuts the prefixes itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def slices_for(df: DataFrame, symbols: int) -> int:
    """Slices a series so that all cores have work: one where there are as many series as cores."""
    return max(1, -(-parallelism(df) // max(1, symbols)))


def by_slice(df: DataFrame, columns: Sequence[str], slices: int, run: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str, *, beside: DataFrame | None = None) -> DataFrame:
    """run(rows of a series in order of rn, slice) for each slice of each series; shuffled are ``slices`` copies of the rows, however many prefixes are cut from them.

    ``beside`` (symbol, slice, ...) may hold rows of its own for each slice: then run(rows, slice, those rows)."""
    rows = df.select("symbol", "rn", *columns).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys, parts = ["symbol", "slice"], parallelism(df)
    left = rows.repartition(parts, *keys).groupBy(*keys)
    drop = lambda pdf: pdf.sort_values("rn").drop(columns="slice").reset_index(drop=True)
    if beside is None:
        return left.applyInPandas(lambda pdf: run(drop(pdf), int(pdf["slice"].iloc[0])), schema)
    names = [x.split()[0] for x in fields(schema)]

    def both(pdf: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return run(drop(pdf), int(pdf["slice"].iloc[0]), other) if len(pdf) and len(other) else pd.DataFrame(columns=names)

    return left.cogroup(beside.repartition(parts, *keys).groupBy(*keys)).applyInPandas(both, schema)


def fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out: list[str] = [""]
    depth = 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def lengths(df: DataFrame, least: int, why: str) -> DataFrame:
    """symbol and n; a series of ``least`` rows or fewer is an error that names it."""
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    short = F.raise_error(F.concat(F.lit("series "), "symbol", F.lit(f" has no more than {why} = {least} rows"))).cast("long")
    return n.withColumn("n", F.when(F.col("n") > least, F.col("n")).otherwise(short))
