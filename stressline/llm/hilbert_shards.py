"""Sharding along a Hilbert curve, with DataFrame functions only.

Every metadata dimension is quantised to 2**bits levels that spread over the whole range. Numbers get
levels of about equal weight (boundaries from approximate percentiles over all rows). Strings are compared whole: the
distinct values are counted, and a value's level is the middle of its share of the rows in code-point order, so a few values lie
far apart on the curve and names that share a long beginning stay apart. The cell's index on the Hilbert curve comes from a table of
2**(bits * dimensions) entries. Rows are range-partitioned and sorted by
(index, tie columns), so files of one shard cover few values of each
dimension and min/max statistics prune on all of them.

The sorted run is cut by rank under the law ``rows``: shard s holds the ranks from
ceil(s * n / k) on, so counts differ by one at most. The rank is the
row's place in its range partition plus the sizes of the partitions before it, one
row a partition. Ties in the whole sort key are rows with equal content, so their
order does not matter; repeated rows are placed once each. Null values form the lowest level of a dimension. Empty and very
long texts count by their size alone. An empty table gives no rows. Columns of any name pass
through ``shard_by_hilbert``; one that is called like a result column comes back with ``_`` after its name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch, fresh


def hilbert_table(bits: int, dims: int) -> list[int]:
    """Curve index of each cell; the cell number holds ``bits`` bits of each dimension, first dimension highest."""
    out = []
    for cell in range(1 << (bits * dims)):
        x = [(cell >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
        for level in range(bits - 1, 0, -1):
            q = 1 << level
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    swap = (x[0] ^ x[d]) & (q - 1)
                    x[0] ^= swap
                    x[d] ^= swap
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        flip = 0
        for level in range(bits - 1, 0, -1):
            if x[dims - 1] & (1 << level):
                flip ^= (1 << level) - 1
        x = [v ^ flip for v in x]
        index = 0
        for level in range(bits - 1, -1, -1):
            for d in range(dims):
                index = index << 1 | (x[d] >> level) & 1
        out.append(index)
    return out


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType))


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")


def string_levels(df: DataFrame, name: str, levels: int, scratch: Scratch) -> DataFrame:
    """(value, level) of each distinct non-null value: the level in the middle of its share of the rows, values in code-point order.

    A cumulative count in two steps: within range partitions of the values, and over the partitions' totals, one row each."""
    counted = df.select(F.col(name).cast("string").alias("value")).where("value is not null").groupBy("value").count()
    counted = counted.repartitionByRange("value").sortWithinPartitions("value").withColumn("mark", F.monotonically_increasing_id())
    counted = scratch.save(counted, f"values_{uuid.uuid4().hex[:8]}").withColumn("part", F.shiftright("mark", 33))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("part").agg(F.sum("count").alias("n"))  # one row a range partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    inner = F.sum("count").over(Window.partitionBy("part").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", inner).join(F.broadcast(parts), "part")
    middle = F.col("before") + F.col("upto") - F.col("count") / 2
    return placed.select("value", F.least(F.lit(levels - 1), F.floor(middle * levels / F.col("all"))).cast("int").alias("level"))


RESULT = ("hilbert", "rank", "shard", "slot")


def shard_by_hilbert(df: DataFrame, dims: list[str], *, shards: int, tie: list[str], bits: int = 4, broadcast_values: int = 200_000, broadcast_bytes: int = 1 << 25, scratch: Scratch | None = None) -> DataFrame:
    """All columns of df and hilbert (curve index), rank, shard and slot (gapless from 0 in its shard). Columns of df
    with one of these names are renamed: ``_`` is put after them."""
    if not dims or bits * len(dims) > 12:
        raise ValueError("bits * dimensions must be from 1 to 12")
    renamed = {c: fresh(df, f"{c}_")[0] for c in df.columns if c.lower() in RESULT}
    df = df.withColumnsRenamed(renamed)
    dims, tie = [renamed.get(c, c) for c in dims], [renamed.get(c, c) for c in tie]
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "hilbert")
    cell_, level_, mark, part, before, every = fresh(df, "_cell", "_level", "_mark", "_part", "_before", "_all")
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [d for d in dims if _is_number(df, d)]
    bounds = df.agg(*(F.percentile_approx(_number(df, d), steps, 2000).alias(f"q{i}") for i, d in enumerate(numbers))).first() if numbers else []  # 2**bits numbers a dimension

    cell, keyed = F.lit(0), df
    for i, d in enumerate(dims):
        if d in numbers:
            edges = sorted(set(bounds[numbers.index(d)] or []))
            # Few distinct edges are spread over the range, too.
            level = sum(((_number(df, d) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
            level = F.floor(level * ((1 << bits) - 1) / max(1, len(edges))).cast("int") if len(edges) < len(steps) else level
            level = F.when(F.col(d).isNull(), 0).otherwise(level)
        else:
            values = scratch.save(string_levels(df, d, 1 << bits, scratch), f"levels{i}")
            name = f"{level_}{i}"
            side = values.select(F.col("value").alias(f"{name}v"), F.col("level").alias(name))
            held, size = values.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
            side = F.broadcast(side) if held <= broadcast_values and size <= broadcast_bytes else side.hint("merge")
            keyed = keyed.join(side, F.col(d).cast("string") == F.col(f"{name}v"), "left").drop(f"{name}v")
            level = F.coalesce(F.col(name), F.lit(0))
        cell = cell * (1 << bits) + level
    table = F.expr(f"array({', '.join(map(str, hilbert_table(bits, len(dims))))})")
    keyed = keyed.withColumn(cell_, cell).withColumn("hilbert", F.element_at(table, F.col(cell_) + 1).cast("long")).select(*(F.col(f"`{c}`") for c in df.columns), "hilbert")

    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["hilbert", *tie]
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.withColumn(mark, F.monotonically_increasing_id())  # partition and place in it
    placed = scratch.save(placed, "sorted")
    in_part = (1 << 33) - 1
    sizes = placed.groupBy(F.shiftright(mark, 33).alias(part)).agg(F.count("*").alias("n"))  # one row a range partition
    w = Window.orderBy(part)
    sizes = sizes.select(part, F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum("n").over(Window.partitionBy(F.lit(0))).alias(every))
    ranked = placed.withColumn(part, F.shiftright(mark, 33)).join(F.broadcast(sizes), part)
    ranked = ranked.withColumn("rank", F.col(before) + F.col(mark).bitwiseAND(F.lit(in_part)))
    shard = F.expr(f"(rank * {shards}L) div `{every}`")
    first = F.expr(f"(shard * `{every}` + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).drop(mark, part, before, every)


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """Sharded rows as one folder a shard; a shard's rows stay sorted along the curve."""
    sharded.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The documents' digest: doc_id, size, text_crc32, law, shard, slot, grown_shard; also hilbert."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    out = shard_by_hilbert(base, ["source", "lang", "size"], shards=shards, tie=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert", "source", "lang")
