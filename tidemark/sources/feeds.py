"""Captured exchange messages: pages of bars, books, compressed frames, channels, request strings."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch_to_timestamp
from tidemark.runtime import ship

PAGE = "status string, data array<struct<id: long, open: double, high: double, low: double, close: double, vol: double>>"


def page_bars(pages: DataFrame) -> DataFrame:
    """Bars of pages(instrument, page, body), body being JSON. Pages that aren't `ok` or can't be read
    give none; a bar that two pages repeat is that of the later page."""
    rows = pages.select("instrument", "page", F.from_json("body", PAGE).alias("body")).filter("body.status = 'ok'")
    rows = rows.select("instrument", "page", F.explode("body.data").alias("bar"))
    last = rows.groupBy("instrument", F.col("bar.id").alias("id")).agg(F.max_by("bar", "page").alias("bar"))
    return last.select("instrument", epoch_to_timestamp(F.col("id")).cast("timestamp_ntz").alias("ts"), "bar.open", "bar.high", "bar.low", "bar.close", F.col("bar.vol").alias("volume"))


def levels(pairs: Column) -> Column:
    """Arrays of [price, amount] as structs."""
    return F.transform(pairs, lambda x: F.struct(F.get(x, F.lit(0)).alias("price"), F.get(x, F.lit(1)).alias("amount")))


def unpacked(df: DataFrame, frame: str, out: str) -> DataFrame:
    """df with the text of gzip frames; null for a null frame and for one that can't be read."""
    ship(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(gunzip_all, "string")(frame))


def gunzip(frame: bytes | None) -> str | None:
    try:
        return None if frame is None else gzip.decompress(frame).decode()
    except (OSError, EOFError, UnicodeDecodeError):
        return None


def gunzip_all(frames: pd.Series) -> pd.Series:
    return frames.map(gunzip, na_action="ignore")


def channel(symbol: Column, *rest: Column) -> Column:
    """The channel of a market stream; its second part is the symbol."""
    return F.concat_ws(".", F.lit("market"), symbol, *rest)


def channel_symbol(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(2))


def request_string(params: Column) -> Column:
    """A map of parameters as a query string, sorted by name and percent-encoded."""
    part = lambda x: F.concat(x["key"], F.lit("="), F.url_encode(x["value"]))
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), part), "&")


def with_defaults(given: Column, defaults: Column) -> Column:
    """A map with the default entries that it lacks and that aren't empty."""
    return F.map_concat(given, F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k) & (v != "")))
