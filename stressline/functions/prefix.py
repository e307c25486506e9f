"""Running totals over sorted keys that may be hot: prefix sums in two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bucket(df: DataFrame, order: str, buckets: int) -> Column:
    """The place of a value among cuts; the cuts are quantiles of all rows, taken in the same plan, so a bucket holds about one part in ``buckets`` of
    the rows and of any key's rows no more than that. Equal values share a bucket."""
    shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    cuts = df.agg(F.percentile_approx(order, shares, F.lit(20 * buckets)).alias("cuts")).scalar()
    value = F.col(order).cast("double")
    return F.array_position(F.sort_array(F.concat(cuts.cast("array<double>"), F.array(value))), value)


def running_totals(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], *, descending: bool = False, buckets: int = 64) -> DataFrame:
    """For each value column v: {v}_upto, its total over the key's rows up to this one in order, this one included, and {v}_all, the key's total. df has one row a (key, order).

    Rows are summed inside range buckets of (key, order) and the buckets, at most ``buckets`` a key, among themselves, so a key with most of the rows is
    spread over tasks."""
    keys = list(keys)
    ranged = df.withColumn("_bucket", range_bucket(df, order, buckets))
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    per = ranged.groupBy(*keys, "_bucket").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    earlier = Window.partitionBy(*keys).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per = per.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}_before") for v in values), *(F.sum(f"_{v}").over(whole).alias(f"{v}_all") for v in values))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(per, [*keys, "_bucket"])
    return out.withColumns({f"{v}_upto": F.sum(v).over(inside) + F.col(f"_{v}_before") for v in values}).drop("_bucket", *(f"_{v}_before" for v in values))
