"""Chart and strategy queries over the daily bars of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY
from tidemark.operators import chart as C
from tidemark.operators import indicators as ind
from tidemark.operators import strategy as T
from tidemark.plans.indicator_queries import ALL_BEFORE, BARS, DMA_CTE, TIE, gate, r, rounded
from tidemark.plans.registry import query
from tidemark.sources import bars as B

OHLC = "open, high, low, close, volume"


@query(f"WITH {BARS} SELECT instrument, ts, {OHLC} FROM (SELECT *, min(least(open, high, low, close)) OVER (PARTITION BY instrument) AS least FROM bars) WHERE least > 0")
def validate_series(spark, sf_dir):
    return C.valid_series(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *OHLC.split(", "))


@query(f"WITH {BARS} SELECT instrument, ts, {OHLC} FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 500")
def tail_n(spark, sf_dir):
    return ind.last_rows(B.orders_daily(spark, sf_dir), 500).select("instrument", "ts", *OHLC.split(", "))


@query(f"""WITH {BARS} SELECT instrument, ts, {OHLC} FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) - 1 AS back, count(*) OVER (PARTITION BY instrument) AS n FROM bars)
WHERE back % CAST(ceil(n / 500.0) AS BIGINT) = 0""")
def decimate(spark, sf_dir):
    return C.decimated(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *OHLC.split(", "))


@query(f"""WITH {BARS}, w AS (SELECT *, max(high) OVER (PARTITION BY instrument) - min(low) OVER (PARTITION BY instrument) AS whole FROM bars)
SELECT instrument, ts, CASE WHEN close >= open THEN 'bull' ELSE 'bear' END AS colour, {r('CASE WHEN close <> open THEN abs(close - open) WHEN high <> low THEN 0.1 * (high - low) ELSE 0.001 * whole END', 'body', 3)} FROM w""")
def candle_shape(spark, sf_dir):
    return C.candle_shapes(B.orders_daily(spark, sf_dir)).select("instrument", "ts", "colour", *rounded("body", digits=3))


@query(f"""WITH {DMA_CTE}, g AS (SELECT instrument, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1),
j AS (SELECT dma.*, dma.ts BETWEEN first_ts AND last_ts AS inside FROM dma JOIN g USING (instrument)), k AS (SELECT *, sum(inside::INT) OVER (PARTITION BY instrument, metric) AS n FROM j)
SELECT instrument, metric, CAST(ts AS TIMESTAMP) AS ts, {r('value', 'value')} FROM k WHERE inside OR n = 0""")
def range_fallback(spark, sf_dir):
    bars = B.orders_daily(spark, sf_dir)
    ranges = bars.groupBy(*KEY).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return C.in_range_or_all(ind.displaced_averages(bars), ranges).select("instrument", "metric", "ts", *rounded("value"))


@query(f"WITH {DMA_CTE} SELECT bars.instrument, bars.ts, bars.close, metric, {r('value', 'value')} FROM bars LEFT JOIN dma ON dma.instrument = bars.instrument AND dma.ts = bars.ts")
def combined_ts(spark, sf_dir):
    """Bars with the metrics of their own time: the intended join of prices and indicators."""
    bars = B.orders_daily(spark, sf_dir)
    return bars.select(*KEY, "ts", "close").join(ind.displaced_averages(bars), [*KEY, "ts"], "left").select("instrument", "ts", "close", "metric", *rounded("value"))


@query(f"""WITH {DMA_CTE}, m AS (SELECT instrument, count(*) AS n_metrics, sum(value) AS total FROM dma GROUP BY 1) SELECT bars.instrument, bars.ts, n_metrics FROM bars JOIN m USING (instrument)""")
def combined_asis(spark, sf_dir):
    """The join as first written lacks the time key, so each bar meets all metrics of its series.
    They are summed by series first, which gives the size of that product without making it."""
    bars = B.orders_daily(spark, sf_dir)
    sizes = ind.displaced_averages(bars).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_metrics"))
    return bars.select(*KEY, "ts").join(sizes, list(KEY)).drop("timeframe")


@query(f"WITH {BARS} SELECT instrument, {r('min(low) * 0.99', 'bottom', 3)}, {r('max(high) * 1.01', 'top', 3)}, {r('max(volume) * 1.2', 'volume_top')}, {r('(epoch(max(ts)) - epoch(min(ts))) / nullif(count(*) - 1, 0) * 0.7', 'width_seconds', 3)} FROM bars GROUP BY 1")
def axis_extents(spark, sf_dir):
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    width = F.try_divide(seconds / 1e6, F.count(F.lit(1)) - 1) * 0.7
    return B.orders_daily(spark, sf_dir).groupBy("instrument").agg(F.round(F.min("low") * 0.99, 3).alias("bottom"), F.round(F.max("high") * 1.01, 3).alias("top"), F.round(F.max("volume") * 1.2, 4).alias("volume_top"), F.round(width, 3).alias("width_seconds"))


CROSS = f"""{BARS}, g AS (SELECT *, sign(({gate('avg', 'close', 9)}) - ({gate('avg', 'close', 21)})) AS gap FROM bars), b AS (SELECT *, lag(gap) OVER (PARTITION BY instrument ORDER BY ts) AS before FROM g),
crosses AS (SELECT instrument, ts, close, CAST(gap AS INTEGER) AS side FROM b WHERE gap <> before AND gap <> 0)"""
TRADES = f"{CROSS}, led AS (SELECT *, lead(close) OVER (PARTITION BY instrument ORDER BY ts) AS exit FROM crosses), trades AS (SELECT *, side * (exit / close - 1) AS profit FROM led WHERE exit IS NOT NULL)"


@query(f"WITH {CROSS} SELECT * FROM crosses")
def ma_cross(spark, sf_dir):
    return T.average_crosses(B.orders_daily(spark, sf_dir)).drop("timeframe")


@query(f"""WITH {BARS}, w AS (SELECT *, count(high) OVER p AS n, max(high) OVER p AS top, min(low) OVER p AS bottom FROM bars WINDOW p AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT instrument, ts, close, CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 END AS side FROM w WHERE n = 20 AND (close > top OR close < bottom)""")
def breakout(spark, sf_dir):
    return T.breakouts(B.orders_daily(spark, sf_dir)).drop("timeframe")


@query(f"""WITH {BARS}, e AS (SELECT instrument, arg_min(close, ts) AS c0, arg_max(close, ts) AS c1, epoch(min(ts)) AS t0, epoch(max(ts)) AS t1 FROM bars GROUP BY 1),
s AS (SELECT b.instrument, b.ts, sign(close - (c0 + (c1 - c0) * ((epoch(b.ts) - t0) / nullif(t1 - t0, 0)))) AS side FROM bars b JOIN e USING (instrument)), l AS (SELECT *, lag(side) OVER (PARTITION BY instrument ORDER BY ts) AS before FROM s)
SELECT instrument, ts, CAST(side AS INTEGER) AS side FROM l WHERE side <> before AND side <> 0 AND before <> 0""")
def line_breakout(spark, sf_dir):
    return T.line_breaks(B.orders_daily(spark, sf_dir)).drop("timeframe")


@query(f"""WITH {TRADES}, e AS (SELECT *, sum(profit) {ALL_BEFORE} AS equity FROM trades), p AS (SELECT *, greatest(max(equity) {ALL_BEFORE}, 0) AS peak FROM e)
SELECT instrument, count(*) AS total_trades, count(*) FILTER (profit > 0) AS winning_trades, count(*) FILTER (profit <= 0) AS losing_trades, {r('sum(profit)', 'total_profit')},
  {r('count(*) FILTER (profit > 0) / count(*)', 'win_rate')}, {r('max(peak - equity)', 'max_drawdown')}, {r('avg(profit) / nullif(stddev_samp(profit), 0)', 'sharpe_ratio')} FROM p GROUP BY 1""")
def backtest_stats(spark, sf_dir):
    out = T.backtest(T.trades(T.average_crosses(B.orders_daily(spark, sf_dir))))
    return out.select("instrument", "total_trades", "winning_trades", "losing_trades", *rounded("total_profit", "win_rate", "max_drawdown", "sharpe_ratio"))


def exits_sql(target: float, stop: float | None) -> str:
    """Each trade with the bars inside it."""
    stopped = f"WHEN worst <= -{stop} THEN 'stop'" if stop is not None else ""
    return f"""WITH {CROSS}, t AS (SELECT *, lead(ts) OVER (PARTITION BY instrument ORDER BY ts) AS next_ts FROM crosses),
j AS (SELECT t.instrument, t.ts, t.side, t.next_ts, b.ts AS bar_ts, CASE WHEN side > 0 THEN b.high / t.close - 1 ELSE 1 - b.low / t.close END AS best,
  CASE WHEN side > 0 THEN b.low / t.close - 1 ELSE 1 - b.high / t.close END AS worst FROM t JOIN bars b ON b.instrument = t.instrument AND b.ts > t.ts AND b.ts <= t.next_ts),
k AS (SELECT *, CASE {stopped} WHEN best >= {target} THEN 'target' WHEN bar_ts = next_ts THEN 'signal' END AS kind FROM j)
SELECT instrument, ts, side, min(bar_ts) AS exit_ts, arg_min(kind, bar_ts) AS exit_kind FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3"""


@query(exits_sql(0.2, 0.1))
def exit_signals(spark, sf_dir):
    """Where each trade ends: target, stop or the next signal, bar by bar."""
    bars = B.orders_daily(spark, sf_dir)
    return T.exits(bars, T.average_crosses(bars), target=0.2, stop=0.1).drop("timeframe")


@query(exits_sql(0.15, None))
def exit_targets(spark, sf_dir):
    """Trades with a target alone, as a range strategy has."""
    bars = B.orders_daily(spark, sf_dir)
    return T.exits(bars, T.average_crosses(bars), target=0.15, stop=None).drop("timeframe")


@query(f"WITH {BARS}, p AS (SELECT *, max(close) {ALL_BEFORE} AS peak FROM bars) SELECT instrument, {r('max((peak - close) / peak)', 'drawdown')} FROM p GROUP BY 1")
def drawdown(spark, sf_dir):
    return T.drawdown(B.orders_daily(spark, sf_dir)).select("instrument", *rounded("drawdown"))


@query(f"""WITH {BARS}, l AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS before FROM bars) SELECT instrument, ts, {r(f'(count(*) FILTER (close > before) {ALL_BEFORE} + 1.0) / (count(before) {ALL_BEFORE} + 2.0) + {TIE}', 'prob_up')},
  {r(f'1 - (count(*) FILTER (close > before) {ALL_BEFORE} + 1.0) / (count(before) {ALL_BEFORE} + 2.0) + {TIE}', 'prob_down')}, {r(f'1 - 1 / sqrt(count(before) {ALL_BEFORE} + 2.0) + {TIE}', 'confidence')} FROM l""")
def prob_beta(spark, sf_dir):
    names = ("prob_up", "prob_down", "confidence")
    return T.rising_odds(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *[F.round(F.col(c) + TIE, 4).alias(c) for c in names])


@query(f"WITH {DMA_CTE}, n AS (SELECT instrument, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 300) SELECT bars.instrument, bars.ts, {', '.join(r(f'max(CASE WHEN metric = {chr(39)}DMA_{p}x{d}{chr(39)} THEN value END)', f'dma_{p}x{d}') for p, d in ind.DMA_COMBINATIONS)} FROM bars JOIN n USING (instrument) LEFT JOIN dma ON dma.instrument = bars.instrument AND dma.ts = bars.ts GROUP BY 1, 2")
def training_frame(spark, sf_dir):
    """Series of 300 bars or more with their metrics as columns: a training set's wide form."""
    bars = B.orders_daily(spark, sf_dir)
    long_enough = bars.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n >= 300").select(*KEY)
    names = [f"DMA_{p}x{d}" for p, d in ind.DMA_COMBINATIONS]
    wide = ind.displaced_averages(bars).groupBy(*KEY, "ts").pivot("metric", names).agg(F.max("value"))
    out = bars.join(long_enough, list(KEY), "left_semi").select(*KEY, "ts").join(wide, [*KEY, "ts"], "left")
    return out.select("instrument", "ts", *[F.round(F.col(n), 4).alias(n.lower()) for n in names])
