"""Captured answers of data services in their own shapes, brought to bars, symbols and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import newest_first
from tidemark.functions.scalars import TIMEFRAMES

# Days of history that a source gives for short timeframes; others give all.
HISTORY_DAYS = {"1m": 7, "5m": 7, "15m": 7, "30m": 7, "1h": 730}
# What a fund service's error codes mean.
FUND_ERRORS = {
    10400: "Invalid ETF name",
    13403: "Insufficient asset to create ETF",
    13404: "Create and redemption disabled due to system setup",
    13405: "Create and redemption disabled due to configuration issue",
    13406: "Invalid API call",
    13410: "API authentication fails",
    13500: "System error",
    13601: "Create and redemption disabled during rebalance",
    13603: "Create and redemption disabled due to other reason",
    13604: "Create suspended",
    13605: "Redemption suspended",
    13606: "Amount incorrect. For the cases when creation amount or redemption amount is not in the range of min/max amount",
}
PRICES = ("open", "high", "low", "close", "volume")


def array_bars(pages: DataFrame) -> DataFrame:
    """Bars of pages(instrument, body), body being JSON of arrays [milliseconds, open, high, low,
    close, volume, ...]: numbers, or numbers in quotes. Where there is a ninth value it is the number of
    trades, else that is 0. A bar that several pages hold is given once; arrays without a time give
    none, and a price that isn't a number is null."""
    rows = pages.select("instrument", F.explode(F.from_json("body", "array<array<string>>")).alias("x"))
    at = lambda i: F.get("x", F.lit(i))
    bars = rows.select(
        "instrument", F.timestamp_millis(at(0).try_cast("long")).cast("timestamp_ntz").alias("ts"),
        *[at(i).try_cast("double").alias(c) for i, c in enumerate(PRICES, 1)], F.coalesce(at(8).try_cast("long"), F.lit(0)).alias("trades"),
    )
    return bars.filter("ts is not null").groupBy("instrument", "ts").agg(F.min(F.struct(*PRICES, "trades")).alias("bar")).select("instrument", "ts", "bar.*")


def frame_bars(frame: DataFrame) -> DataFrame:
    """A frame with titled columns (Open, High, Low, Close, Volume) under the names of bars; it
    carries no number of trades."""
    return frame.withColumnsRenamed({c.title(): c for c in PRICES}).withColumn("trades", F.lit(0).cast("long"))


def within_history(bars: DataFrame, code: str, now: Column) -> DataFrame:
    """The bars that a source with a short memory would still give at now."""
    return bars.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(HISTORY_DAYS[code]))) if code in HISTORY_DAYS else bars


def recent_days(code: str, limit: int) -> int:
    """Days that a source is asked for to get the last limit bars."""
    if code in ("1m", "5m", "15m", "30m"):
        return 7
    return min(max(7, limit // 24 + 1) if code == "1h" else max(30, limit + 1), 730)


def recent_bars(bars: DataFrame, limit: int, now: Column, page: int = 1000) -> DataFrame:
    """The last bars of each series, no more than a page and none older than what a source is asked for."""
    codes = F.create_map(*[F.lit(x) for code, _ in TIMEFRAMES for x in (code, recent_days(code, limit))])
    rows = bars.filter(F.col("ts") >= now - F.make_dt_interval(F.coalesce(F.try_element_at(codes, F.col("timeframe")), F.lit(recent_days("", limit)))))
    return rows.withColumn("_rank", F.row_number().over(newest_first())).filter(F.col("_rank") <= min(limit, page)).drop("_rank")


def within_years(bars: DataFrame, now: Column, years: float = 2.0) -> DataFrame:
    """The default window of a history: so many years of 365 days up to now."""
    return bars.filter(F.col("ts").between(now - F.make_dt_interval(F.lit(int(years * 365))), now))


def record_bars(records: DataFrame) -> DataFrame:
    """Bars of records(instrument, fields), fields being a map of strings: keys in lower case or
    titled, time as `timestamp` or as seconds under `id`; what is missing is 0, volume has two
    decimals (halves to even)."""
    field = lambda c: F.coalesce(F.try_element_at("fields", F.lit(c)), F.try_element_at("fields", F.lit(c.title())), F.lit("0")).cast("double")
    ts = F.coalesce(F.to_timestamp(F.try_element_at("fields", F.lit("timestamp"))), F.timestamp_seconds(F.try_element_at("fields", F.lit("id")).cast("long")))
    return records.select("instrument", ts.cast("timestamp_ntz").alias("ts"), *[field(c).alias(c) for c in PRICES[:4]], F.bround(field("volume"), 2).alias("volume"))


def fund_error(code: Column) -> Column:
    """What an error code of the fund service means; empty for any other."""
    texts = F.create_map(*[F.lit(v) for pair in FUND_ERRORS.items() for v in pair])
    return F.coalesce(F.try_element_at(texts, code), F.lit(""))


def judged(answers: DataFrame, body: str = "body") -> DataFrame:
    """answers with accepted and fault. An answer's `status`, else its `code`, else its `success`
    decides: ok, 200 or true. fault tells what a refused one says; one with none of the three, or
    that isn't JSON, is refused."""
    x = F.from_json(body, "status string, code string, success boolean, `err-code` string, `err-msg` string, message string")
    status, code = (F.when(x[c] != "", x[c]) for c in ("status", "code"))
    said = F.coalesce(x["message"], F.lit(""))
    fault = (
        F.when(status == "error", F.concat_ws(": ", F.coalesce(x["err-code"], F.lit("0")), F.coalesce(x["err-msg"], F.lit(""))))
        .when(status.isNotNull(), F.when(status != "ok", F.concat(F.lit("unexpected status "), status)))
        .when(code.isNotNull(), F.when(code != "200", F.concat_ws(": ", code, said)))
        .when(x["success"].isNotNull(), F.when(~x["success"], said))
        .otherwise("no status")
    )
    return answers.withColumn("fault", fault).withColumn("accepted", F.col("fault").isNull())


def listed(symbols: DataFrame, quote: str = "USDT") -> DataFrame:
    """Distinct names BASEQUOTE of the active symbols(base, quote, active) against this quote."""
    return symbols.filter(F.col("active") & (F.upper("quote") == quote)).select(F.concat(F.upper("base"), F.lit(quote)).alias("symbol")).distinct()


def with_volume(symbols: DataFrame, tickers: DataFrame) -> DataFrame:
    """symbols joined once with their tickers(symbol, vol, ...), whatever the case of the names;
    symbols without a ticker or without volume go."""
    priced = tickers.filter(F.coalesce("vol", F.lit(0.0)) != 0).withColumn("name", F.lower("symbol")).drop("symbol")
    return symbols.withColumn("name", F.lower("symbol")).join(priced, "name").drop("name")
