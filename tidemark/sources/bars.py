"""Ticks to OHLCV bars, and bars to coarser bars. A series is (instrument, timeframe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import table


def to_bars(ticks: DataFrame, instrument: Column, timeframe: str, bar: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """instrument, timeframe, ts, open, high, low, close, volume: open and close are the first and last price
    by order, which must be unique in a bar. One aggregation with map-side partials."""
    rows = ticks.select(instrument.alias("instrument"), bar.alias("ts"), price.alias("price"), order.alias("seq"), volume.alias("volume"))
    bars = rows.groupBy("instrument", "ts").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select("instrument", F.lit(timeframe).alias("timeframe"), "ts", "open", "high", "low", "close", "volume")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices by priority."""
    t = table(spark, sf_dir, "orders")
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    return to_bars(t, F.col("o_orderpriority"), "1d", day, F.col("o_totalprice"), F.col("o_orderkey"), F.lit(1.0))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by type."""
    t = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return to_bars(t, F.col("event_type"), "1h", hour, F.col("value"), F.struct("ts", "event_id"), F.lit(1.0))


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume-weighted bars of unit prices by return flag and line status."""
    t = table(spark, sf_dir, "lineitem")
    day = F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")
    price = F.try_divide("l_extendedprice", "l_quantity")
    return to_bars(t, F.concat("l_returnflag", "l_linestatus"), "1d", day, price, F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), F.col("l_quantity"))


def resample(bars: DataFrame, timeframe: str, bar: Column) -> DataFrame:
    """Coarser bars of series of one timeframe, so that 2h, 4h and longer timeframes hold bars of their
    own length."""
    coarse = bars.groupBy("instrument", bar.alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )
    return coarse.select("instrument", F.lit(timeframe).alias("timeframe"), F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def orders_daily_and_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily and weekly bars of order prices in one table, as bars of several timeframes are stored."""
    daily = orders_daily(spark, sf_dir)
    return daily.unionByName(resample(daily, "1w", F.date_trunc("week", "ts").cast("timestamp_ntz")))
