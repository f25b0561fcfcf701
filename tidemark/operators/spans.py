"""Windows and running sums over long series, in parallel.

A series is cut into spans of time, of as many lengths of its timeframe each, so a span of bars has a bounded
number of rows without counting them. For windows that look back, a span gets copies of the rows
before it, from as many spans as it takes; running sums add up what the spans before them sum to. Only
the last rows of spans and one row of sums a span are moved a second time.

Defined results: those of the same windows over whole series (sums of floats up to their last bits); series of
no known timeframe are cut as daily ones; an empty table gives an empty result; rows without a time are
the first ones of their series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY
from tidemark.functions.scalars import TIMEFRAMES, looked_up

#: Lengths of its timeframe that a span of a series has.
SPAN = 2048


def span_of(span: int) -> Column:
    minutes = looked_up(F.col("timeframe"), dict(TIMEFRAMES), 1440).cast("long")
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (minutes * 60 * span))


def by_key(small: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], Column]]:
    """small with its key columns renamed, and the null-safe condition that joins rows with it."""
    renamed = small.withColumnsRenamed({n: f"_of_{n}" for n in names})

    def same(rows: DataFrame) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & rows[n].eqNullSafe(renamed[f"_of_{n}"])
        return out

    return renamed, same


def in_spans(bars: DataFrame, look_back: int, f: Callable[[DataFrame], DataFrame], span: int = SPAN) -> DataFrame:
    """f(bars), where f adds columns by windows of a series that see no row more than look_back rows before
    theirs and none after it. f is given the instrument together with the span, as one column, and must
    keep all columns."""
    rows = bars.withColumn("_span", span_of(span))
    newest = Window.partitionBy(*KEY, "_span").orderBy(F.col("ts").desc())
    ends = rows.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= look_back)
    # Counts up to look_back are enough: no row is needed beyond a span that has so many.
    order = Window.partitionBy(*KEY).orderBy("_span")
    sizes = ends.groupBy(*KEY, "_span").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_end", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.collect_list(F.struct(F.col("_span").alias("to"), (F.col("_end") - F.col("_n")).alias("at"))).over(order.rowsBetween(1, look_back))
    feeds = sizes.withColumn("_later", later).select(*KEY, "_span", "_end", F.explode("_later").alias("_later"))
    feeds = feeds.select(*KEY, "_span", F.col("_later.to").alias("_to"), (F.col("_later.at") - F.col("_end")).alias("_gap")).filter(F.col("_gap") < look_back)
    feeds, same = by_key(feeds, *KEY, "_span")
    copies = ends.join(feeds, same(ends)).filter(F.col("_back") + F.col("_gap") <= look_back)
    copies = copies.select(*bars.columns, F.col("_to").alias("_span"), F.lit(False).alias("_own"))
    cut = rows.withColumn("_own", F.lit(True)).unionByName(copies)
    out = f(cut.withColumn("instrument", F.struct("instrument", "_span")))
    return out.filter("_own").withColumn("instrument", F.col("instrument.instrument")).drop("_span", "_own")


def running(rows: DataFrame, sums: tuple[str, ...] = (), maxima: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """rows(KEY, ts, ...) whose columns of these names hold the sum, or the largest value, of the series up to
    and with the row."""
    of = dict.fromkeys(sums, F.sum) | dict.fromkeys(maxima, F.max)
    cut = rows.withColumn("_span", span_of(span))
    before = Window.partitionBy(*KEY).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*KEY, "_span").agg(*[f(n).alias(f"_end_{n}") for n, f in of.items()])
    ends = ends.select(*KEY, "_span", *[f(f"_end_{n}").over(before).alias(f"_before_{n}") for n, f in of.items()])
    ends, same = by_key(ends, *KEY, "_span")
    so_far = Window.partitionBy(*KEY, "_span").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({n: f(n).over(so_far) for n, f in of.items()})
    out = out.join(ends, same(out))
    both = {n: (F.col(n), F.col(f"_before_{n}")) for n in of}
    whole = {n: F.greatest(x, y) if n in maxima else F.coalesce(x + y, x, y) for n, (x, y) in both.items()}
    return out.withColumns(whole).select(*rows.columns)
