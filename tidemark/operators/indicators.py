"""Technical indicators as window expressions: one exchange and one sort for a span of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY, gated, highest, lag, last, lowest, newest_first, rolling_sum, series, sma
from tidemark.operators.spans import SPAN, by_key, in_spans, running

# Lengths and displacements of averages, ratios of retracement.
DMA_COMBINATIONS = ((3, 3), (7, 5), (25, 5))
FIB_RATIOS = (0.236, 0.382, 0.5, 0.618)


def h():
    return F.col("high")


def l():  # noqa: E743
    return F.col("low")


def c():
    return F.col("close")


def v():
    return F.col("volume")


def base(bars: DataFrame) -> DataFrame:
    """Columns that several indicators need, computed once."""
    before = lag(c())
    return bars.withColumns({"before": before, "tp": (h() + l() + c()) / 3}).withColumns({
        "gain": F.greatest(F.coalesce(c() - F.col("before"), F.lit(0.0)), F.lit(0.0)),
        "loss": F.greatest(F.coalesce(F.col("before") - c(), F.lit(0.0)), F.lit(0.0)),
        "tr": F.greatest(h() - l(), F.abs(h() - F.col("before")), F.abs(l() - F.col("before"))),
    })


def rsi(n: int = 14):
    gain, loss = sma(F.col("gain"), n), sma(F.col("loss"), n)
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, F.lit(100.0))


def stochastic_k(n: int = 14):
    return F.try_divide(100 * (c() - lowest(l(), n)), highest(h(), n) - lowest(l(), n))


def williams_r(n: int = 14):
    return F.try_divide(100 * (c() - highest(h(), n)), highest(h(), n) - lowest(l(), n))


def cci(n: int = 20):
    """Needs the columns tp_mean and tps, the mean and the list of the last n typical prices."""
    apart = F.aggregate("tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("tp_mean"))) / n
    return F.try_divide(F.col("tp") - F.col("tp_mean"), 0.015 * apart)


def wma(x, n: int):
    """Weights 1..n, the newest heaviest."""
    return gated(F.sum(x), x, n).isNotNull(), sum((F.lag(x, k).over(series()) * (n - k) for k in range(1, n)), x * n) / (n * (n + 1) / 2)


def gated_wma(x, n: int):
    full, value = wma(x, n)
    return F.when(full, value)


def first_steps(bars: DataFrame) -> DataFrame:
    """KEY and the seconds between the first two bars of each series; series of one bar have none."""
    first = bars.select(*KEY, "ts").withColumn("_nth", F.row_number().over(series())).filter("_nth <= 2")
    ends = first.groupBy(*KEY).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("second_ts"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return ends.select(*KEY, F.timestamp_diff("SECOND", "first_ts", "second_ts").alias("step"))


def displaced_averages(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """instrument, timeframe, metric, ts, value: the mean of the last p closes, stored d steps later. A step is
    the time between the first two bars of the series; series of one bar have none."""
    means = {f"dma_{p}x{d}": sma(c(), p) for p, d in DMA_COMBINATIONS}
    rows = in_spans(bars.select(*KEY, "ts", "close"), max(p for p, _ in DMA_COMBINATIONS) - 1, lambda x: x.withColumns(means), span)
    steps, same = by_key(first_steps(bars), *KEY)
    entries = F.array(*[F.struct(F.lit(f"DMA_{p}x{d}").alias("metric"), F.lit(d).alias("d"), F.col(f"dma_{p}x{d}").alias("value")) for p, d in DMA_COMBINATIONS])
    long = rows.join(steps, same(rows)).select(*KEY, "ts", "step", F.explode(entries).alias("e")).filter("e.value is not null")
    return long.select(*KEY, F.col("e.metric").alias("metric"), F.timestamp_add("SECOND", F.col("step") * F.col("e.d"), "ts").alias("ts"), F.col("e.value").alias("value"))


def with_rolling(bars: DataFrame) -> DataFrame:
    """bars with all indicators of bounded windows; the longest one sees ROLLING_BACK rows before its own."""
    rows = base(bars)
    rows = rows.withColumns({
        "sma9": sma(c(), 9), "sma14": sma(c(), 14), "sma21": sma(c(), 21), "sma50": sma(c(), 50), "rsi14": rsi(), "k14": stochastic_k(), "williams14": williams_r(), "tp_mean": sma(F.col("tp"), 20),
        "tps": F.collect_list("tp").over(last(20)), "atr14": sma(F.col("tr"), 14), "boll_mid": sma(c(), 20), "boll_dev": gated(F.stddev_pop(c()), c(), 20), "donchian_high": highest(h(), 20), "donchian_low": lowest(l(), 20),
        "mf": F.coalesce(F.try_divide((c() - l()) - (h() - c()), h() - l()), F.lit(0.0)) * v(),
    })
    return rows.withColumns({"cci20": cci(), "d3": sma(F.col("k14"), 3), "prediction": F.col("sma9") - F.col("sma21"), "boll_up": F.col("boll_mid") + 2 * F.col("boll_dev"), "boll_low": F.col("boll_mid") - 2 * F.col("boll_dev"), "cmf20": F.try_divide(rolling_sum(F.col("mf"), 20), rolling_sum(v(), 20))})


#: Rows before its own that any rolling indicator sees.
ROLLING_BACK = 50


def rolling_indicators(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """The wide frame of all indicators of bounded windows, span by span."""
    return in_spans(bars, ROLLING_BACK, with_rolling, span)


def flows(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """KEY, ts and what a bar adds to the running indicators: volume by the direction of the close, typical
    price by volume, volume."""
    rows = in_spans(bars.select(*KEY, "ts", "high", "low", "close", "volume"), 1, base, span)
    signed = F.coalesce(F.signum(c() - F.col("before")) * v(), F.lit(0.0))
    return rows.select(*KEY, "ts", signed.alias("obv"), (F.col("tp") * v()).alias("turnover"), "volume")


def running_indicators(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """KEY, ts, obv and vwap: sums from the beginning of each series."""
    sums = running(flows(bars, span), ("obv", "turnover", "volume"), span=span)
    return sums.select(*KEY, "ts", "obv", F.try_divide("turnover", "volume").alias("vwap"))


def daily_vwap(bars: DataFrame) -> DataFrame:
    """KEY, ts and vwap from the beginning of each day, by windows of a day's rows."""
    so_far = Window.partitionBy(*KEY, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    tp = (h() + l() + c()) / 3
    return bars.select(*KEY, "ts", F.try_divide(F.sum(tp * v()).over(so_far), F.sum(v()).over(so_far)).alias("vwap"))


def latest_indicators(bars: DataFrame) -> DataFrame:
    """The last bar of each series with all its indicators, rolling and running ones: from the newest rows
    and from sums, without a window over a whole series."""
    newest = last_bar(with_rolling(last_rows(bars, ROLLING_BACK + 1)))
    sums = flows(bars).groupBy(*KEY).agg(F.sum("obv").alias("obv"), F.try_divide(F.sum("turnover"), F.sum("volume")).alias("vwap"))
    sums, same = by_key(sums, *KEY)
    return newest.join(sums, same(newest)).drop(*[f"_of_{k}" for k in KEY])


def hull(bars: DataFrame, n: int = 21, span: int = SPAN) -> DataFrame:
    smooth = int(n**0.5)

    def add(x: DataFrame) -> DataFrame:
        return x.withColumn("raw", 2 * gated_wma(c(), n // 2) - gated_wma(c(), n)).withColumn("hma", gated_wma(F.col("raw"), smooth))

    return in_spans(bars, n + smooth - 2, add, span)


def ichimoku(bars: DataFrame, span: int = SPAN) -> DataFrame:
    mid = lambda n: (highest(h(), n) + lowest(l(), n)) / 2

    def add(x: DataFrame) -> DataFrame:
        return x.withColumns({"a": mid(9), "b": mid(52)}).withColumns({"span_a": lag(F.col("a"), 26), "span_b": lag(F.col("b"), 26)})

    return in_spans(bars, 51 + 26, add, span)


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each series; Spark keeps n rows of a group before the exchange."""
    return bars.withColumn("rank", F.row_number().over(newest_first())).filter(F.col("rank") <= n).drop("rank")


def last_bar(bars: DataFrame) -> DataFrame:
    rest = [c for c in bars.columns if c not in KEY]
    return bars.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "ts").alias("bar")).select(*KEY, "bar.*")


def fib_support(bars: DataFrame, n: int = 50) -> DataFrame:
    """Resistance below the high and support above the low of the last n bars, by ratio."""
    ends = last_rows(bars, n).groupBy(*KEY).agg(F.max("high").alias("high"), F.min("low").alias("low"))
    rows = ends.select(*KEY, "high", "low", F.explode(F.array(*[F.lit(x) for x in FIB_RATIOS])).alias("ratio"))
    spread = F.col("high") - F.col("low")
    return rows.select(*KEY, "ratio", (F.col("high") - spread * F.col("ratio")).alias("resistance"), (F.col("low") + spread * F.col("ratio")).alias("support"))


# The names of a snapshot's metrics, with the columns that hold them.
SNAPSHOT = {
    "SMA 14": "sma14", "SMA 50": "sma50", "EMA 9": "ema9", "RSI 14": "rsi14", "AMA 14": "ama14", "MACD": "macd", "Signal Line": "macd_signal", "MACD Histogram": "macd_hist", "Stochastic %K": "k14", "Stochastic %D": "d3",
    "Prediction Signal": "prediction", "OP": "op", "XOP": "xop", "COP": "cop", "Support": "support", "Resistance": "resistance", "CCI": "cci20", "OBV": "obv", "ATR": "atr14", "Williams %R": "williams14",
}


def named_snapshot(bars: DataFrame) -> DataFrame:
    """KEY, ts, metric, value: the latest value of each of the twenty named metrics of every series, where
    there is one. Support and resistance are those of the last ratio."""
    from tidemark.operators.recursive import affine_indicators

    spread = h() - l()
    ends = last_rows(bars, 50).groupBy(*KEY).agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    ends, same = by_key(ends, *KEY)
    newest = latest_indicators(bars)
    band = (F.col("top") - F.col("bottom")) * FIB_RATIOS[-1]
    newest = newest.join(ends, same(newest)).withColumns({"op": c(), "xop": h() + 1.618 * spread, "cop": h() - 0.5 * spread, "support": F.col("bottom") + band, "resistance": F.col("top") - band})
    recurring = ("ema9", "macd", "macd_signal", "macd_hist", "ama14")
    newest = newest.select(*KEY, "ts", *[x for x in SNAPSHOT.values() if x not in recurring])
    newest = newest.join(affine_indicators(bars, names=recurring), [*KEY, "ts"])
    entries = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(column).alias("value")) for name, column in SNAPSHOT.items()])
    return newest.select(*KEY, "ts", F.inline(entries)).filter("value is not null and not isnan(value)")
