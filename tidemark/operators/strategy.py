"""Signals, exits and the figures of a backtest, as windows over a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY, lag, series, sma
from tidemark.operators import indicators as ind
from tidemark.operators.relational import as_of
from tidemark.operators.spans import SPAN, by_key, in_spans, running


def average_crosses(bars: DataFrame, fast: int = 9, slow: int = 21, span: int = SPAN) -> DataFrame:
    """instrument, ts, close, side: bars where the fast mean goes over (1) or under (-1) the slow."""

    def add(x: DataFrame) -> DataFrame:
        return x.withColumn("gap", F.signum(sma(F.col("close"), fast) - sma(F.col("close"), slow))).withColumn("gap_before", lag(F.col("gap")))

    rows = in_spans(bars, max(fast, slow), add, span)
    return rows.filter("gap <> gap_before and gap <> 0").select(*KEY, "ts", "close", F.col("gap").cast("int").alias("side"))


def breakouts(bars: DataFrame, n: int = 20, span: int = SPAN) -> DataFrame:
    """Closes above the high, or below the low, of the n bars before."""
    w = series().rowsBetween(-n, -1)
    rows = in_spans(bars, n, lambda x: x.withColumns({"n": F.count("high").over(w), "top": F.max("high").over(w), "bottom": F.min("low").over(w)}), span).filter(F.col("n") == n)
    side = F.when(F.col("close") > F.col("top"), 1).when(F.col("close") < F.col("bottom"), -1)
    return rows.withColumn("side", side).filter("side is not null").select(*KEY, "ts", "close", "side")


def threshold_signals(bars: DataFrame, n: int = 14, low: float = 30.0, high: float = 70.0, span: int = SPAN) -> DataFrame:
    """instrument, ts, price, side: bars where the RSI enters the zone under low (BUY) or over high
    (SELL)."""

    def add(x: DataFrame) -> DataFrame:
        rows = ind.base(x).withColumn("rsi", ind.rsi(n))
        rows = rows.withColumn("side", F.when(F.col("rsi") < low, "BUY").when(F.col("rsi") > high, "SELL"))
        return rows.withColumn("side_before", lag(F.col("side")))

    rows = in_spans(bars, n + 1, add, span)
    return rows.filter(F.col("side").isNotNull() & ~F.col("side").eqNullSafe(F.col("side_before"))).select(*KEY, "ts", F.col("close").alias("price"), "side")


def line_breaks(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """Bars whose close crosses the straight line from the first to the last close of the series."""
    rows = bars.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    ends = rows.groupBy(*KEY).agg(F.min_by("close", "ts").alias("c0"), F.max_by("close", "ts").alias("c1"), F.min("at").alias("t0"), F.max("at").alias("t1"))
    ends, same = by_key(ends, *KEY)
    line = F.col("c0") + (F.col("c1") - F.col("c0")) * F.try_divide(F.col("at") - F.col("t0"), F.col("t1") - F.col("t0"))
    rows = rows.join(ends, same(rows)).select(*KEY, "ts", F.signum(F.col("close") - line).alias("side"))
    rows = in_spans(rows, 1, lambda x: x.withColumn("before", lag(F.col("side"))), span)
    return rows.filter("side <> before and side <> 0 and before <> 0").select(*KEY, "ts", F.col("side").cast("int").alias("side"))


STRATEGY = "name string, kind string, direction string, take_profit double, stop_loss double"


def line_breakout_strategy(name: str, direction: str = "up", take_profit: float = 0.02, stop_loss: float = 0.01) -> tuple:
    """Enter where a line is broken in a direction; leave at a target or a stop."""
    return name, "breakout", direction, take_profit, stop_loss


def rectangle_strategy(name: str, kind: str = "bounce", take_profit: float = 0.015) -> tuple:
    """Trade inside a range, or its break; leave at a target alone."""
    return name, kind, None, take_profit, None


def run_strategies(bars: DataFrame, crosses: DataFrame, strategies: list[tuple]) -> DataFrame:
    """The exits of the crosses under each strategy, by its name; those of another direction are left out."""
    out = None
    for name, _, direction, target, stop in strategies:
        some = exits(bars, crosses, target, stop)
        some = some if direction is None else some.filter(F.col("side") == (1 if direction == "up" else -1))
        some = some.withColumn("strategy", F.lit(name))
        out = some if out is None else out.unionByName(some)
    return out


def without(strategies: list[tuple], index: int) -> list[tuple]:
    """The list without the one at a place; as it is for a place beyond it."""
    return strategies[:index] + strategies[index + 1 :] if 0 <= index < len(strategies) else strategies


def held(crosses: DataFrame, span: int = SPAN) -> DataFrame:
    """The crosses that another one of their series follows, with its price (exit) and time (next_ts)."""
    entry = F.struct(*[c for c in crosses.columns if c not in KEY])
    rows = in_spans(crosses, 1, lambda x: x.withColumn("entry", lag(entry)), span).filter("entry is not null")
    return rows.select(*KEY, "entry.*", F.col("close").alias("exit"), F.col("ts").alias("next_ts"))


def trades(crosses: DataFrame, span: int = SPAN) -> DataFrame:
    """Each cross is held until the next one: entry, exit and relative profit."""
    return held(crosses, span).drop("next_ts").withColumn("profit", F.col("side") * (F.col("exit") / F.col("close") - 1))


def drawdown(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """KEY and the largest fall of the close below the highest one before it, as a share of that."""
    rows = running(bars.select(*KEY, "ts", "close", F.col("close").alias("peak")), maxima=("peak",), span=span)
    return rows.groupBy(*KEY).agg(F.max((F.col("peak") - F.col("close")) / F.col("peak")).alias("drawdown"))


def backtest(held: DataFrame, span: int = SPAN) -> DataFrame:
    """Figures of the trades of each series; the drawdown is that of the summed profit."""
    rows = running(held.withColumn("equity", F.col("profit")), ("equity",), span=span)
    rows = running(rows.withColumn("peak", F.greatest("equity", F.lit(0.0))), maxima=("peak",), span=span)
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(F.col("profit") > 0).alias("winning_trades"), F.count_if(F.col("profit") <= 0).alias("losing_trades"),
        F.sum("profit").alias("total_profit"), F.try_divide(F.count_if(F.col("profit") > 0), F.count(F.lit(1))).alias("win_rate"),
        F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.try_divide(F.avg("profit"), F.stddev_samp("profit")).alias("sharpe_ratio"),
    )


def exits(bars: DataFrame, crosses: DataFrame, target: float = 0.02, stop: float | None = 0.01) -> DataFrame:
    """KEY, ts, side, exit_ts and exit_kind of each cross that another one follows: whether a bar inside
    the trade reaches the target or the stop first (the stop, if one bar reaches both), or the next cross
    ends it. Without a stop only the target and the next cross do. Each bar looks at the trade it is in,
    so trades aren't joined with their bars."""
    # A trade begins after its bar, so it is looked up from a microsecond later on.
    begins = (F.col("ts") + F.expr("interval 1 microsecond")).alias("ts")
    entry = held(crosses).select(*KEY, begins, F.struct(F.col("ts").alias("ts"), F.col("close").alias("price"), "side", "next_ts").alias("trade"))
    rows = as_of(bars, entry, [*KEY], "ts", "trade", "year").filter("ts <= trade.next_ts")
    price, side = F.col("trade.price"), F.col("trade.side")
    best = F.when(side > 0, F.col("high") / price - 1).otherwise(1 - F.col("low") / price)
    worst = F.when(side > 0, F.col("low") / price - 1).otherwise(1 - F.col("high") / price)
    kind = F.when(worst <= -stop, "stop") if stop is not None else F.when(F.lit(False), "stop")
    kind = kind.when(best >= target, "target").when(F.col("ts") == F.col("trade.next_ts"), "signal")
    ends = rows.withColumn("kind", kind).filter("kind is not null").groupBy(*KEY, F.col("trade.ts").alias("entry_ts"), side.alias("side")).agg(F.min(F.struct("ts", "kind")).alias("end"))
    return ends.select(*KEY, F.col("entry_ts").alias("ts"), "side", F.col("end.ts").alias("exit_ts"), F.col("end.kind").alias("exit_kind"))


def rising_odds(bars: DataFrame, a: float = 1.0, b: float = 1.0, span: int = SPAN) -> DataFrame:
    """The mean of the Beta posterior that a bar closes higher, or doesn't, by all bars so far, and a
    confidence that grows from 0 with the weight of the posterior."""
    rows = in_spans(bars.select(*KEY, "ts", "close"), 1, lambda x: x.withColumn("before", lag(F.col("close"))), span)
    up, n = F.coalesce(F.col("close") > F.col("before"), F.lit(False)).cast("int"), F.col("before").isNotNull().cast("int")
    rows = running(rows.select(*KEY, "ts", up.alias("up"), n.alias("n")), ("up", "n"), span=span)
    odds = (F.col("up") + a) / (F.col("n") + a + b)
    return rows.select(*KEY, "ts", odds.alias("prob_up"), (1 - odds).alias("prob_down"), (1 - 1 / F.sqrt(F.col("n") + a + b)).alias("confidence"))
