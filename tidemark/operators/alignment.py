"""Sources in order of preference, rows paired by position, gaps of bars, what is due."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY
from tidemark.functions.scalars import refresh_seconds


def first_nonempty(sources: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first source that has any, with the source's number."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("source_number", F.lit(i)) for i, s in enumerate(sources)])
    best = rows.groupBy(F.col(key).alias("best_key")).agg(F.min("source_number").alias("best"))
    return rows.join(best, F.col(key).eqNullSafe(F.col("best_key")) & (F.col("source_number") == F.col("best"))).drop("best_key", "best")


def by_position(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str) -> DataFrame:
    """The k-th row of a key on the left with its k-th row on the right, as far as both go."""
    place = lambda df, by: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    return place(left, left_by).join(place(right, right_by), [key, "place"])


def mean_gap(bars: DataFrame, key: str, ts: str) -> DataFrame:
    """The mean distance in seconds of neighbours in time: their whole span by their number less
    one, so that no sort is needed; null for a single row."""
    span = (F.max(F.unix_micros(F.col(ts).cast("timestamp"))) - F.min(F.unix_micros(F.col(ts).cast("timestamp")))) / 1e6
    return bars.groupBy(key).agg(F.try_divide(span, F.count(ts) - 1).alias("mean_gap"))


def due(last: DataFrame, now: DataFrame) -> DataFrame:
    """Series whose last bar is at least a refresh interval of their timeframe old:
    last(instrument, timeframe, last_ts) and now(now) of one row. A series without a bar is due."""
    age = F.unix_seconds(now.select("now").scalar().cast("timestamp")) - F.unix_seconds(F.col("last_ts").cast("timestamp"))
    return last.filter(F.col("last_ts").isNull() | (age >= refresh_seconds(F.col("timeframe")))).select(*KEY)


def shapes(points: DataFrame) -> DataFrame:
    """Rectangle, triangle tip and circle that two points (x0, y0) and (x1, y1) span."""
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    width, height = F.abs(x1 - x0), F.abs(y1 - y0)
    return points.withColumns({
        "corner_x": F.least(x0, x1), "corner_y": F.least(y0, y1), "width": width, "height": height,
        "tip_x": (x0 + x1) / 2, "tip_y": F.least(y0, y1) - height / 2, "radius": F.sqrt(width * width + height * height),
    })
