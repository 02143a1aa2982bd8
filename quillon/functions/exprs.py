"""Column expressions shared by the operators. Nothing here raises on bad cells: they become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def num(c: Column | str) -> Column:
    """As double; text that is no number, NaN and null are null."""
    x = (col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def total(c: Column) -> Column:
    """A sum that is 0 where all is null."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def flag(c: Column | str) -> Column:
    """True where a number is above 0."""
    return F.coalesce(num(c), F.lit(0.0)) > 0


def stamp(c: Column | str) -> Column:
    """As timestamp; other forms than ISO are tried one by one, the rest is null."""
    x = col(c) if isinstance(c, str) else c
    s = x.cast("string")
    forms = ("yyyy/M/d HH:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "yyyy-M-d", "yyyyMMdd", "M/d/yyyy", "yyyy.M.d")
    # most text is no date, and a failed parse is dear: only what begins like one is tried
    return F.when(s.rlike(r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]?|^\s*\d{8}\s*$"), F.coalesce(x.try_cast("timestamp"), *(F.try_to_timestamp(s, F.lit(f)) for f in forms)))


def day(c: Column | str) -> Column:
    return F.to_date(stamp(c))


def typed_day(df, name: str) -> Column:
    """The day of a column that may be typed already."""
    kind = dict(df.dtypes)[name]
    return F.to_date(col(name)) if kind in ("date", "timestamp", "timestamp_ntz") else day(name)


def typed_stamp(df, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return col(name).cast("timestamp") if kind in ("date", "timestamp", "timestamp_ntz") else stamp(name)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between timestamps."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def array_median(xs: Column) -> Column:
    """The median of an array of doubles, by sorting it; null if empty."""
    s = F.array_sort(xs)
    n = F.size(s)
    low = F.try_element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    high = F.try_element_at(s, F.greatest(F.ceil((n + 1) / 2), F.lit(1)).cast("int"))
    return (low + high) / 2


def array_mean(xs: Column) -> Column:
    return div(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs).cast("double"))


def array_std(xs: Column, mean: Column) -> Column:
    """Sample deviation; null below two values."""
    sq = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(xs) > 1, F.sqrt(sq / (F.size(xs) - 1)))
