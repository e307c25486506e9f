"""Column helpers that all operators share: guarded rolling aggregates, clipping, banding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ANNUAL = 252**0.5


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """NaN is missing everywhere in this engine, so it becomes NULL at every boundary."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds that keep NULL (greatest and least skip it)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def by_symbol(symbol: str = "symbol", date: str = "date") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(date)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def guarded(agg: Callable[[Column], Column], c: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """A rolling aggregate over n rows, NULL until ``least`` (all n by default) of them have a value."""
    c = col(c)
    frame = last_n(w, n)
    return F.when(F.count(c).over(frame) >= (n if least is None else least), agg(c).over(frame))


def rolling_std(c: str | Column, n: int, w: WindowSpec) -> Column:
    return guarded(F.stddev_samp, c, n, w)


def sample_skew(c: str | Column, n: int, w: WindowSpec) -> Column:
    """Bias-corrected skewness of a full window."""
    return guarded(F.skewness, c, n, w) * ((n * (n - 1)) ** 0.5 / (n - 2))


def sample_kurtosis(c: str | Column, n: int, w: WindowSpec) -> Column:
    """Bias-corrected excess kurtosis of a full window."""
    return (guarded(F.kurtosis, c, n, w) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def bounded_fill(c: str | Column, limit: int, w: WindowSpec) -> Column:
    """The last value of at most ``limit`` rows back where this row has none."""
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(-limit, 0))


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the columns that have a value."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(total, n)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def rounded(df, digits: int = 6, keep: Sequence[str] = ()):
    """All floating columns rounded, for output."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes))
