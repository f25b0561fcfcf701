"""Scalar rules: timeframes, symbols, epochs, JSON records, candles, display strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Timeframe codes with their length in minutes.
TIMEFRAMES = [
    ("1m", 1), ("3m", 3), ("5m", 5), ("15m", 15), ("30m", 30), ("1h", 60), ("2h", 120), ("4h", 240), ("6h", 360), ("12h", 720), ("1d", 1440), ("1w", 10080), ("1mo", 43200),
]
# Newest bars shown by timeframe; all others show 500.
SHOWN = {"2h": 400, "4h": 300, "6h": 300, "12h": 300, "1w": 200, "1mo": 100}
DISPLAY_ZONE = "Europe/Moscow"


def timeframes(spark: SparkSession) -> DataFrame:
    """code, minutes, seconds, shown: a dimension of fixed size."""
    rows = [(code, m, m * 60, SHOWN.get(code, 500)) for code, m in TIMEFRAMES]
    return spark.createDataFrame(rows, "code string, minutes int, seconds int, shown int")


def epoch_to_timestamp(x: Column) -> Column:
    """Seconds, milliseconds or microseconds since 1970, told apart by magnitude."""
    return F.when(x >= 10**14, F.timestamp_micros(x)).when(x >= 10**11, F.timestamp_millis(x)).otherwise(F.timestamp_seconds(x))


def to_display(ts: Column) -> Column:
    """A UTC time on the display zone's clock, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(DISPLAY_ZONE), ts)


def spaced(x: Column) -> Column:
    """Two decimals, thousands apart by spaces."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(" "))


def body(o: Column, h: Column, low: Column, c: Column, whole_range: Column) -> Column:
    """The height of a candle's body: a flat one is a tenth of its range, or a thousandth of the
    series' range where that is flat too."""
    return F.when(c != o, F.abs(c - o)).when(h != low, 0.1 * (h - low)).otherwise(0.001 * whole_range)


def zero_unless_positive(o: Column, c: Column) -> Column:
    """The change in percent, 0 where the open isn't positive."""
    return F.when(o > 0, (c - o) / o * 100).otherwise(F.lit(0.0))


# How a time is shown on an axis, by timeframe; all others show hours and minutes.
AXIS_FORMATS = {"1d": "dd MMM", "1w": "dd.MM", "1mo": "dd.MM", **dict.fromkeys(("1h", "2h", "4h", "6h", "12h"), "dd.MM HH:mm")}


def axis_label(code: Column, ts: Column) -> Column:
    by_format: dict[str, list[str]] = {}
    for k, v in AXIS_FORMATS.items():
        by_format.setdefault(v, []).append(k)
    out = F.date_format(ts, "HH:mm")
    for pattern, codes in by_format.items():
        out = F.when(code.isin(codes), F.date_format(ts, pattern)).otherwise(out)
    return out


def day_number(ts: Column) -> Column:
    """Days since 1970 with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 86_400e6


def day_start(ts: Column) -> Column:
    """Epoch seconds of the start of the day on the display zone's clock."""
    return F.unix_seconds(F.to_utc_timestamp(F.date_trunc("day", to_display(ts)).cast("timestamp"), DISPLAY_ZONE))


# Years of history to load and seconds between updates, by timeframe; others load two
# years.
HISTORY_YEARS = {"1m": 0.5, "3m": 0.5, "5m": 0.5, "15m": 1.0, "30m": 1.0, "1h": 1.5, "2h": 1.5}
REFRESH_SECONDS = {
    "1m": 60, "3m": 60, "5m": 60, "15m": 900, "30m": 900, "1h": 3600, "2h": 3600, "4h": 14400, "6h": 14400, "12h": 14400, "1d": 86400, "1w": 86400, "1mo": 86400,
}


def looked_up(code: Column, table: dict, otherwise) -> Column:
    """The value of a code in a fixed table of a few entries."""
    pairs = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(otherwise))


def coalesced_name(interval_name: Column, name: Column, code: Column) -> Column:
    """A timeframe's name by the first of its fields that is there."""
    return F.coalesce(interval_name, name, code)


def history_years(code: Column) -> Column:
    return looked_up(code, HISTORY_YEARS, 2.0)


# Days that an update goes back at most, by timeframe; others a year.
BACKFILL_DAYS = {"1m": 7, "3m": 7, "5m": 7, "15m": 30, "30m": 30, "1h": 90, "2h": 90}


def backfill_days(code: Column) -> Column:
    return looked_up(code, BACKFILL_DAYS, 365)


def refresh_seconds(code: Column, otherwise: int = 60) -> Column:
    return looked_up(code, REFRESH_SECONDS, otherwise)


def beijing_to_utc_millis(x: Column) -> Column:
    """UTC milliseconds of an epoch on the clock eight hours ahead, in seconds or milliseconds; 0 for
    one before the year 2000."""
    # The year 2000 on that clock, and its distance in seconds.
    first, ahead = 946_656_000, 8 * 3600
    return F.when(x > first * 1000, x - ahead * 1000).when((x > first) & (x < first * 1000), (x - ahead) * 1000).otherwise(F.lit(0).cast("long"))


def beijing_seconds_to_utc_millis(x: Column) -> Column:
    """UTC milliseconds of seconds on the clock eight hours ahead; 0 for ones up to the year 2000 there
    and for what can only be milliseconds."""
    first = 946_656_000
    return F.when((x > first) & (x < first * 1000), (x - 8 * 3600) * 1000).otherwise(F.lit(0).cast("long"))


def beijing_millis_to_utc_millis(x: Column) -> Column:
    """UTC milliseconds of milliseconds on the clock eight hours ahead; 0 for ones up to the year 2000 there."""
    return F.when(x > 946_656_000_000, x - 8 * 3600 * 1000).otherwise(F.lit(0).cast("long"))


def filled(template: str, **values: Column) -> Column:
    """A message template with {name} in it, filled from columns in one go, so that braces in a value
    stay as they are; a missing value shows as N/A."""
    parts = [F.coalesce(values[p[1:-1]].cast("string"), F.lit("N/A")) if p[1:-1] in values and p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template)]
    return F.concat(*parts)


def source_symbol(symbol: Column, names: dict[str, str], quote: str = "USDT") -> Column:
    """A symbol's name at a source: that of a map of names, or else with / before the quote currency."""
    cut = F.concat(F.substring(symbol, F.lit(1), F.length(symbol) - len(quote)), F.lit(f"/{quote}"))
    return looked_up(symbol, names, F.when(F.endswith(symbol, F.lit(quote)), cut).otherwise(symbol))
