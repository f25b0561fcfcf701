"""Window expressions over a series, gated so that a value appears only after a full warm-up. A series is
what has one instrument and one timeframe."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


KEY = ("instrument", "timeframe")


def whole():
    return Window.partitionBy(*KEY)


def series():
    return whole().orderBy("ts")


def newest_first():
    return whole().orderBy(F.col("ts").desc())


def last(n: int):
    return series().rowsBetween(1 - n, 0)


def gated(agg: Column, x: Column, n: int) -> Column:
    """agg over the last n rows where all of them hold a value."""
    return F.when(F.count(x).over(last(n)) == n, agg.over(last(n)))


def sma(x: Column, n: int) -> Column:
    return gated(F.avg(x), x, n)


def highest(x: Column, n: int) -> Column:
    return gated(F.max(x), x, n)


def lowest(x: Column, n: int) -> Column:
    return gated(F.min(x), x, n)


def rolling_sum(x: Column, n: int) -> Column:
    return gated(F.sum(x), x, n)


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(series())
