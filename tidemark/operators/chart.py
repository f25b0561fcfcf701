"""What a chart asks of a series: validation, the newest bars, decimation, candle shapes, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY
from tidemark.operators.spans import SPAN, by_key, running

PRICES = ("open", "high", "low", "close")


def valid_series(bars: DataFrame) -> DataFrame:
    """Rows without a null, of series without any price at or below zero."""
    rows = bars.na.drop("any")
    valid, same = by_key(rows.groupBy(*KEY).agg(F.min(F.least(*PRICES)).alias("_least")).filter("_least > 0"), *KEY)
    return rows.join(valid, same(rows), "left_semi")


def decimated(bars: DataFrame, most: int = 500, span: int = SPAN) -> DataFrame:
    """At most so many bars of a series, evenly spaced, counted back from the newest one."""
    rows = running(bars.withColumn("nth", F.lit(1)), ("nth",), span=span)
    sizes, same = by_key(bars.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), *KEY)
    step = F.ceil(F.col("n") / most)
    return rows.join(sizes, same(rows)).filter((F.col("n") - F.col("nth")) % step == 0).select(*bars.columns)


def candle_shapes(bars: DataFrame) -> DataFrame:
    """Colour and body height of each candle."""
    from tidemark.functions.scalars import body

    heights, same = by_key(bars.groupBy(*KEY).agg((F.max("high") - F.min("low")).alias("whole")), *KEY)
    rows = bars.join(heights, same(bars))
    rising = F.when(F.col("close") >= F.col("open"), "bull").otherwise("bear")
    return rows.select(*KEY, "ts", rising.alias("colour"), body(*map(F.col, PRICES), F.col("whole")).alias("body"))


def in_range_or_all(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points within the first and last bar of their series; all of them where none lies there."""
    rows = points.join(ranges, list(KEY)).withColumn("inside", F.col("ts").between(F.col("first_ts"), F.col("last_ts")))
    some, same = by_key(rows.filter("inside").select(*KEY, "metric").distinct().withColumn("some", F.lit(True)), *KEY, "metric")
    return rows.join(some, same(rows), "left").filter("inside or some is null").select(*points.columns)
