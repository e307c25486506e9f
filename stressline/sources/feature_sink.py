"""Feature tables laid out for windows over a series: bucketed by symbol, sorted by date, one file a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def write_features(df: DataFrame, name: str, *, path: str | None = None, buckets: int | None = None, mode: str = "overwrite") -> DataFrame:
    """Writes the table and returns it read again. Rows are exchanged by symbol once, here; later windows, groups and joins by symbol need no exchange, and windows by date no sort."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, "symbol").write.mode(mode).format("parquet").bucketBy(n, "symbol").sortBy("symbol", "date")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return read_features(spark, name)


def read_features(spark: SparkSession, name: str) -> DataFrame:
    """The table, with its order made known to the planner: each bucket is one sorted file."""
    spark.conf.set(ORDERED, "true")
    return spark.table(name)


def replace_series(df: DataFrame, name: str, *, path: str | None = None) -> DataFrame:
    """The table with the series of df in place of its own of the same symbols; others stay as they are. The new table is written under another name first and takes the name
    over only when it is whole, so a failed write loses nothing."""
    spark = df.sparkSession
    old = read_features(spark, name)
    n = int(next(r["data_type"] for r in spark.sql(f"describe extended {name}").collect() if r["col_name"] == "Num Buckets"))
    changed = df.select(F.col("symbol").alias("_changed")).distinct()
    kept = old.join(changed, old["symbol"].eqNullSafe(F.col("_changed")), "left_anti")
    fresh = f"{name}_next"
    write_features(kept.unionByName(df.select(*old.columns)), fresh, path=path, buckets=n)
    spark.sql(f"drop table {name}")
    spark.sql(f"alter table {fresh} rename to {name}")
    return read_features(spark, name)
