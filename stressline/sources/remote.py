"""Remote price bars as a Python data source: one partition a symbol, read on the executors, in batch or as a stream of days.

    spark.dataSource.register(BarSource)
    spark.read.format("bars").option("symbols", '["A", "B"]').option("url", "https://host/{symbol}.csv?from={start}&to={end}").load()

The URL gives a CSV with a header (date, open, high, low, close, volume in any case and order). Instead of a URL, ``fetch`` names a function "module:name" of (symbol, first day, last day)
that returns rows of (date, open, high, low, close, volume), or None. Equality and IN filters on symbol choose partitions and comparisons of date shorten the asked range, where
``spark.sql.python.filterPushdown.enabled`` is set; all filters hold in any case. A request that fails is tried again after ``wait`` seconds, twice as long each time. A symbol without rows gives none; rows without a date
are left out; missing prices are NULL. A stream's offset is a day: a batch holds the days after the last one up to ``until`` (a day or "today").
"""

from __future__ import annotations

import csv
import datetime as dt
import importlib
import io
import json
import math
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
FIELDS = ("open", "high", "low", "close", "volume")
DAY = dt.timedelta(days=1)


@dataclass
class Asked(InputPartition):
    """A symbol and the days asked for, both ends included."""

    symbol: str
    start: dt.date
    end: dt.date


def parse_csv(text: str) -> Iterator[tuple]:
    reader = csv.reader(io.StringIO(text))
    names = [x.strip().lower() for x in next(reader, [])]
    at = {n: names.index(n) for n in ("date", *FIELDS) if n in names}
    for row in reader:
        if "date" in at and len(row) > at["date"] and row[at["date"]].strip():
            yield (row[at["date"]].strip()[:10], *(row[at[f]] if f in at and at[f] < len(row) else None for f in FIELDS))


def _number(x) -> float | None:
    try:
        out = float(x)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(out) else out


def _from_url(url: str) -> Callable:
    def fetch(symbol: str, start: dt.date, end: dt.date) -> Iterable[tuple]:
        with urllib.request.urlopen(url.format(symbol=urllib.parse.quote(symbol, safe=""), start=start.isoformat(), end=end.isoformat()), timeout=60) as r:
            return list(parse_csv(r.read().decode()))

    return fetch


def _function(options) -> Callable:
    if "fetch" in options:
        module, _, name = options["fetch"].partition(":")
        return getattr(importlib.import_module(module), name)
    if "url" in options:
        return _from_url(options["url"])
    raise ValueError("bars need a url or a fetch function")


def _rows(options, asked: Asked) -> Iterator[tuple]:
    """Rows of a partition, once the request has succeeded; what lies outside the asked days is dropped."""
    attempts, wait, fetch = int(options.get("attempts", 3)), float(options.get("wait", 2.0)), _function(options)
    for attempt in range(attempts):
        try:
            found = list(fetch(asked.symbol, asked.start, asked.end) or [])
            break
        except Exception:  # whatever a source raises, it gets its further attempts
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)
    for date, *values in found:
        day = date if type(date) is dt.date else dt.date.fromisoformat(str(date)[:10])
        if asked.start <= day <= asked.end:
            yield (asked.symbol, day, *map(_number, values))


def _symbols(options) -> list[str]:
    return list(dict.fromkeys(json.loads(options["symbols"])))


def _day(text: str) -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date() if text == "today" else dt.date.fromisoformat(text)


class BarReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.symbols = dict(options), _symbols(options)
        self.start, self.end = _day(options.get("start", "1900-01-01")), _day(options.get("end", "today"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("symbol",) and isinstance(f, EqualTo):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif column == ("symbol",) and isinstance(f, In):
                self.symbols = [s for s in self.symbols if s in f.value]
            elif column == ("date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, dt.date):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.start = max(self.start, f.value + DAY * isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.end = min(self.end, f.value - DAY * isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Asked(s, self.start, self.end) for s in self.symbols] if self.start <= self.end else []

    def read(self, partition: Asked) -> Iterator[tuple]:
        return _rows(self.options, partition) if partition is not None else iter(())


class BarStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.symbols = dict(options), _symbols(options)

    def initialOffset(self) -> dict:  # noqa: N802 - the interface's name
        return {"day": (_day(self.options.get("start", "1900-01-01")) - DAY).isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": _day(self.options.get("until", "today")).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = _day(start["day"]) + DAY, _day(end["day"])
        return [Asked(s, first, last) for s in self.symbols] if first <= last else []

    def read(self, partition: Asked) -> Iterator[tuple]:
        return _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class BarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BarReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return BarStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarSource)


def read_bars(spark: SparkSession, symbols: Iterable[str], **options) -> DataFrame:
    register(spark)
    return spark.read.format("bars").options(symbols=json.dumps(list(symbols)), **options).load()
