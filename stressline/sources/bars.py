"""Price bars: readers, cleaning, and index bars built from any fact table."""

from __future__ import annotations

import json
import logging
import time
import urllib.parse
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

PRICES = ("open", "high", "low", "close")
DATE_NAMES = ("date", "timestamp")


def slug(ticker: Column) -> Column:
    """File name of a ticker: no caret, underscores for = and /."""
    return F.translate(F.replace(ticker, F.lit("^"), F.lit("")), "=/", "__")


def read_bars_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A CSV with a header; the first column called date or timestamp, in any case, is the date."""
    return clean_bars(spark.read.option("header", True).csv(path), symbol)


def read_bars_parquet(spark: SparkSession, path: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """A cache partitioned by symbol: the filter prunes folders."""
    df = spark.read.parquet(path)
    return df.where(F.col("symbol").isin(list(symbols))) if symbols else df


def write_bars_parquet(df: DataFrame, path: str) -> None:
    df.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").parquet(path)


def clean_bars(raw: DataFrame, symbol: str | Column, sequence: str | None = None) -> DataFrame:
    """symbol, date, open, high, low, close, volume: required columns picked whatever their case (two-part names
    by the part that is a price), values cast, time of day and zone dropped, one row a date: the last by ``sequence``.

    Without a sequence column the ingest order stands for it."""
    found: dict[str, str] = {}
    for name in raw.columns:
        parts = [p.strip(" ()'\"").lower() for p in name.replace(",", ".").split(".")]
        for part in parts:
            if part in (*PRICES, "volume", *DATE_NAMES):
                found.setdefault("date" if part in DATE_NAMES else part, name)
    missing = [p for p in PRICES if p not in found]
    if missing or "date" not in found:
        raise ValueError(f"missing columns: {missing or ['date']}")
    at = lambda c: F.col(f"`{found[c]}`")
    number = lambda c: F.expr(f"try_cast(`{found[c]}` as double)")
    sym = F.lit(symbol) if isinstance(symbol, str) else symbol
    order = F.col(sequence) if sequence else F.monotonically_increasing_id()
    day = F.coalesce(F.expr(f"try_cast(`{found['date']}` as date)"), F.try_to_timestamp(at("date").cast("string")).cast("date"))
    volume = number("volume") if "volume" in found else F.lit(0.0)
    df = raw.select(sym.alias("symbol"), day.alias("date"), *(number(p).alias(p) for p in PRICES), volume.alias("volume"), order.alias("_seq"))
    return dedup_keep_last(df, ["symbol", "date"], "_seq").drop("_seq")


def dedup_keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """One row a key, the one with the highest sequence; a partial aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(sequence)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns))


def exact_bars(df: DataFrame, *, symbol: Column, date: str, value: str, order: str) -> DataFrame:
    """Bars whose open and close are the first and last value of the day by a unique order column."""
    day = df.select(symbol.alias("symbol"), F.col(date).cast("date").alias("date"), F.col(value).cast("double").alias("v"), F.col(order).alias("o"))
    return day.groupBy("symbol", "date").agg(
        F.min_by("v", "o").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "o").alias("close"), F.count("*").cast("double").alias("volume")
    )


def index_bars(df: DataFrame, *, symbol: Column, date: str, value: str, shock: float = 0.01, base: float = 1000.0, digits: int = 4) -> DataFrame:
    """A price-like series a symbol: the standardised daily mean moves the close by ``shock``, the day's relative
    range opens high and low. A fixture for analytics: it standardises over the whole sample, so it is no feature."""
    everything = Window.partitionBy("symbol")
    w = Window.partitionBy("symbol").orderBy("date")
    v = F.col(value).cast("double")
    d = df.groupBy(symbol.alias("symbol"), F.col(date).cast("date").alias("date")).agg(F.avg(v).alias("a"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("volume"))
    z = (F.col("a") - F.avg("a").over(everything)) / F.stddev_samp("a").over(everything)
    p = d.select("symbol", "date", F.col("volume").cast("double").alias("volume"), ((F.col("hi") - F.col("lo")) / F.col("hi")).alias("rng"), (z * shock).alias("step"))
    p = p.withColumn("close", base * F.exp(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    p = p.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    r = lambda c: F.round(c, digits)
    return p.select(
        "symbol",
        "date",
        r(F.col("open")).alias("open"),
        r(F.greatest("open", "close") * (1 + 0.005 * F.col("rng"))).alias("high"),
        r(F.least("open", "close") * (1 - 0.005 * F.col("rng"))).alias("low"),
        r(F.col("close")).alias("close"),
        "volume",
    )


def load_series(
    spark: SparkSession, symbol: str, cache: str, sources: Sequence[Callable[[], DataFrame | None]], *, refresh: bool = False, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep
) -> DataFrame | None:
    """A symbol's bars: from the cache folder, else from the first source that has rows, which are then written to the cache
    and read back. A source that fails is tried again after ``wait`` seconds, twice as long each time. refresh asks the
    sources first and the cache last. None where nothing has rows."""
    path = f"{cache.rstrip('/')}/symbol={urllib.parse.quote(symbol, safe='')}"

    def cached() -> DataFrame | None:
        try:
            df = spark.read.parquet(path).withColumn("symbol", F.lit(symbol))
            return df if df.limit(1).count() else None
        except AnalysisException:  # nothing is cached yet
            return None

    if not refresh and (df := cached()) is not None:
        return df
    for source in sources:
        for attempt in range(attempts):
            try:
                df = source()
                if df is not None and df.limit(1).count():
                    df.drop("symbol").coalesce(1).sortWithinPartitions("date").write.mode("overwrite").parquet(path)  # one series
                    return cached()
                break
            except Exception as e:  # noqa: BLE001 - whatever a source raises, it gets its further attempts
                log.warning("source of %s failed (attempt %d of %d): %s", symbol, attempt + 1, attempts, e)
                if attempt + 1 < attempts:
                    sleep(wait * 2**attempt)
    return cached()


def resolve(primary: DataFrame | None, fallbacks: Sequence[DataFrame | None], optional: dict[str, DataFrame | None]) -> DataFrame:
    """The first source of the primary that has rows, united with those optional series that have some."""
    chosen = next((x for x in (primary, *fallbacks) if x is not None and x.limit(1).count()), None)
    if chosen is None:
        raise RuntimeError("the primary series has no rows in any source")
    for df in optional.values():
        if df is not None and df.limit(1).count():
            chosen = chosen.unionByName(df)
    return chosen


def cache_metadata(df: DataFrame) -> DataFrame:
    """rows, first and last date, and an order-independent content hash of each symbol."""
    row_hash = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(row_hash).cast("string").alias("content_hash"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_json(path: str, value: object) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=str)
