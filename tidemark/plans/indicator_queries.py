"""Indicator queries over the daily bars of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.recursive import affine_indicators
from tidemark.operators.recursive import supertrend as supertrend_of
from tidemark.plans.registry import query
from tidemark.sources import bars as B

#: The bars in SQL.
BARS = """bars AS (
  SELECT o_orderpriority AS instrument, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""
BASE = f"""{BARS}, lagged AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS before, (high + low + close) / 3 AS tp FROM bars),
base AS (SELECT *, greatest(coalesce(close - before, 0), 0) AS gain, greatest(coalesce(before - close, 0), 0) AS loss,
                greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM lagged)"""


def over(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gate(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN {agg}({x}) OVER {over(n)} END"


def rounded(*names: str, digits: int = 4):
    return [F.round(F.col(x), digits).alias(x) for x in names]


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) AS {name}"


def rolling(spark, sf_dir, *names):
    return ind.rolling_indicators(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *rounded(*names))


@query(f"WITH {BARS} SELECT instrument, ts, {', '.join(r(x, x) for x in ('open', 'high', 'low', 'close', 'volume'))} FROM bars")
def bars_daily(spark, sf_dir):
    return B.orders_daily(spark, sf_dir).select("instrument", "ts", *rounded("open", "high", "low", "close", "volume"))


@query(f"""SELECT event_type AS instrument, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, {r('arg_min(value, (ts, event_id))', 'open')}, {r('max(value)', 'high')},
  {r('min(value)', 'low')}, {r('arg_max(value, (ts, event_id))', 'close')}, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")
def bars_hourly(spark, sf_dir):
    return B.events_hourly(spark, sf_dir).select("instrument", "ts", *rounded("open", "high", "low", "close"), "volume")


@query(f"""WITH hourly AS (SELECT event_type AS instrument, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)
SELECT instrument, CAST(time_bucket(INTERVAL 4 HOURS, ts) AS TIMESTAMP) AS ts, {r('arg_min(open, ts)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')},
  {r('arg_max(close, ts)', 'close')}, sum(volume) AS volume FROM hourly GROUP BY 1, 2""")
def resample_4h(spark, sf_dir):
    hourly = B.events_hourly(spark, sf_dir)
    bar = F.timestamp_add("HOUR", -(F.hour("ts") % 4), "ts")
    return B.resample(hourly, "4h", bar).select("instrument", "ts", *rounded("open", "high", "low", "close"), "volume")


@query(f"""WITH t AS (SELECT l_returnflag || l_linestatus AS instrument, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / nullif(l_quantity, 0) AS price,
  l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem)
SELECT instrument, ts, arg_min(price, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close,
  sum(l_quantity) AS volume FROM t GROUP BY 1, 2""")
def bars_lineitem(spark, sf_dir):
    return B.lineitem_daily(spark, sf_dir).drop("timeframe")


@query(f"WITH {BASE} SELECT instrument, ts, {r(gate('avg', 'close', 9), 'sma9')}, {r(gate('avg', 'close', 21), 'sma21')} FROM base")
def sma(spark, sf_dir):
    return rolling(spark, sf_dir, "sma9", "sma21")


@query(f"WITH {BASE}, g AS (SELECT *, {gate('avg', 'gain', 14)} AS g, {gate('avg', 'loss', 14)} AS l FROM base) SELECT instrument, ts, {r('CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END', 'rsi14')} FROM g")
def rsi(spark, sf_dir):
    return rolling(spark, sf_dir, "rsi14")


K = f"(100 * (close - {gate('min', 'low', 14)}) / nullif(({gate('max', 'high', 14)}) - ({gate('min', 'low', 14)}), 0))".replace("- CASE", "- (CASE").replace("END) / nullif", "END)) / nullif")


@query(f"WITH {BASE}, k AS (SELECT instrument, ts, {K} AS k14 FROM base) SELECT instrument, ts, {r('k14', 'k14')}, {r(gate('avg', 'k14', 3), 'd3')} FROM k")
def stochastic(spark, sf_dir):
    return rolling(spark, sf_dir, "k14", "d3")


@query(f"WITH {BASE} SELECT instrument, ts, {r('(' + gate('avg', 'close', 9) + ') - (' + gate('avg', 'close', 21) + ')', 'prediction')} FROM base")
def prediction(spark, sf_dir):
    return rolling(spark, sf_dir, "prediction")


@query(f"WITH {BASE}, w AS (SELECT *, {gate('max', 'high', 14)} AS hh, {gate('min', 'low', 14)} AS ll FROM base) SELECT instrument, ts, {r('100 * (close - hh) / nullif(hh - ll, 0)', 'williams14')} FROM w")
def williams_r(spark, sf_dir):
    return rolling(spark, sf_dir, "williams14")


@query(f"""WITH {BASE}, w AS (SELECT *, {gate('avg', 'tp', 20)} AS m, list(tp) OVER {over(20)} AS l FROM base)
SELECT instrument, ts, {r('(tp - m) / nullif(0.015 * (list_sum(list_transform(l, lambda x: abs(x - m))) / 20), 0)', 'cci20')} FROM w""")
def cci(spark, sf_dir):
    return rolling(spark, sf_dir, "cci20")


@query(f"WITH {BASE} SELECT instrument, ts, {r('sum(coalesce(sign(close - before) * volume, 0)) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)', 'obv')} FROM base")
def obv(spark, sf_dir):
    return ind.running_indicators(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *rounded("obv"))


@query(f"WITH {BASE} SELECT instrument, ts, {r(gate('avg', 'tr', 14), 'atr14')} FROM base")
def atr(spark, sf_dir):
    return rolling(spark, sf_dir, "atr14")


@query(f"WITH {BASE}, w AS (SELECT *, {gate('avg', 'close', 20)} AS m, {gate('stddev_pop', 'close', 20)} AS s FROM base) SELECT instrument, ts, {r('m + 2 * s', 'boll_up', 2)}, {r('m', 'boll_mid')}, {r('m - 2 * s', 'boll_low', 2)} FROM w")
def bollinger(spark, sf_dir):
    return ind.rolling_indicators(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *rounded("boll_up", "boll_low", digits=2), *rounded("boll_mid"))


@query(f"WITH {BASE} SELECT instrument, ts, {r(gate('max', 'high', 20), 'donchian_high')}, {r(gate('min', 'low', 20), 'donchian_low')} FROM base")
def donchian(spark, sf_dir):
    return rolling(spark, sf_dir, "donchian_high", "donchian_low")


#: Values nearer to a tie than this are rounded up, in Spark and SQL alike, whatever the last bit says.
TIE = 1e-9
ALL_BEFORE = "OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {BASE} SELECT instrument, ts, {r(f'sum(tp * volume) {ALL_BEFORE} / nullif(sum(volume) {ALL_BEFORE}, 0) + {TIE}', 'vwap')} FROM base")
def vwap(spark, sf_dir):
    return ind.running_indicators(B.orders_daily(spark, sf_dir)).select("instrument", "ts", F.round(F.col("vwap") + TIE, 4).alias("vwap"))


@query(f"WITH {BASE}, m AS (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mf FROM base) SELECT instrument, ts, {r('(' + gate('sum', 'mf', 20) + ') / nullif(' + gate('sum', 'volume', 20) + ', 0)', 'cmf20')} FROM m")
def cmf(spark, sf_dir):
    return rolling(spark, sf_dir, "cmf20")


def sql_wma(x: str, n: int) -> str:
    terms = " + ".join(f"lag({x}, {k}) OVER (PARTITION BY instrument ORDER BY ts) * {n - k}" for k in range(1, n))
    return f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN ({x} * {n} + {terms}) / {n * (n + 1) / 2} END"


@query(f"WITH {BARS}, raw AS (SELECT instrument, ts, 2 * ({sql_wma('close', 10)}) - ({sql_wma('close', 21)}) AS raw FROM bars) SELECT instrument, ts, {r(sql_wma('raw', 4), 'hma')} FROM raw")
def hma(spark, sf_dir):
    return ind.hull(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *rounded("hma"))


@query(f"""WITH {BARS}, m AS (SELECT instrument, ts, (({gate('max', 'high', 9)}) + ({gate('min', 'low', 9)})) / 2 AS a, (({gate('max', 'high', 52)}) + ({gate('min', 'low', 52)})) / 2 AS b FROM bars)
SELECT instrument, ts, {r('lag(a, 26) OVER (PARTITION BY instrument ORDER BY ts)', 'span_a')}, {r('lag(b, 26) OVER (PARTITION BY instrument ORDER BY ts)', 'span_b')} FROM m""")
def ichimoku(spark, sf_dir):
    return ind.ichimoku(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *rounded("span_a", "span_b"))


LAST = "SELECT instrument, arg_max(high, ts) AS high, arg_max(low, ts) AS low, arg_max(close, ts) AS close FROM bars GROUP BY instrument"


@query(f"WITH {BARS}, b AS ({LAST}) SELECT instrument, {r('(high + low + close) / 3', 'pivot')}, {r('2 * (high + low + close) / 3 - low', 'r1')}, {r('2 * (high + low + close) / 3 - high', 's1')} FROM b")
def pivots(spark, sf_dir):
    rows = ind.last_bar(B.orders_daily(spark, sf_dir))
    p = (F.col("high") + F.col("low") + F.col("close")) / 3
    return rows.select("instrument", F.round(p, 4).alias("pivot"), F.round(2 * p - F.col("low"), 4).alias("r1"), F.round(2 * p - F.col("high"), 4).alias("s1"))


@query(f"WITH {BARS}, b AS ({LAST}) SELECT instrument, {r('close', 'op')}, {r('high + 1.618 * (high - low)', 'xop')}, {r('high - 0.5 * (high - low)', 'cop')} FROM b")
def op_xop_cop(spark, sf_dir):
    rows = ind.last_bar(B.orders_daily(spark, sf_dir))
    spread = F.col("high") - F.col("low")
    return rows.select("instrument", F.round("close", 4).alias("op"), F.round(F.col("high") + 1.618 * spread, 4).alias("xop"), F.round(F.col("high") - 0.5 * spread, 4).alias("cop"))


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS rn FROM bars), e AS (SELECT instrument, max(high) AS high, min(low) AS low FROM n WHERE rn <= 50 GROUP BY 1)
SELECT instrument, CAST(ratio AS DOUBLE) AS ratio, {r('high - (high - low) * ratio', 'resistance')}, {r('low + (high - low) * ratio', 'support')} FROM e, (VALUES (0.236), (0.382), (0.5), (0.618)) AS f(ratio)""")
def fib_sr(spark, sf_dir):
    return ind.fib_support(B.orders_daily(spark, sf_dir)).select("instrument", "ratio", *rounded("resistance", "support"))


@query(f"""WITH {BARS}, e AS (SELECT instrument, max(high) AS high, min(low) AS low FROM bars GROUP BY 1)
SELECT instrument, CAST(ratio AS DOUBLE) AS ratio, {r('high - (high - low) * ratio', 'level')} FROM e, (VALUES (0.0), (0.236), (0.382), (0.5), (0.618), (1.0)) AS f(ratio)""")
def fib_full(spark, sf_dir):
    ends = B.orders_daily(spark, sf_dir).groupBy("instrument").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    rows = ends.select("*", F.explode(F.array(*[F.lit(x) for x in (0.0, *ind.FIB_RATIOS, 1.0)])).alias("ratio"))
    return rows.select("instrument", "ratio", F.round(F.col("high") - (F.col("high") - F.col("low")) * F.col("ratio"), 4).alias("level"))


DMA = ", ".join(f"({p}, {d}, 'DMA_{p}x{d}')" for p, d in ind.DMA_COMBINATIONS)
DMA_VALUE = " ".join(f"WHEN p = {p} THEN {gate('avg', 'close', p)}" for p, _ in ind.DMA_COMBINATIONS).replace("PARTITION BY instrument", "PARTITION BY instrument, p")


DMA_CTE = f"""{BARS}, s AS (SELECT *, min(ts) OVER (PARTITION BY instrument) AS t0, nth_value(ts, 2) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t1 FROM bars),
x AS (SELECT s.*, p, d, metric FROM s, (VALUES {DMA}) AS c(p, d, metric) WHERE t1 IS NOT NULL), y AS (SELECT instrument, metric, ts + (t1 - t0) * d AS ts, CASE {DMA_VALUE} END AS value FROM x),
dma AS (SELECT * FROM y WHERE value IS NOT NULL)"""


@query(f"WITH {DMA_CTE} SELECT instrument, metric, CAST(ts AS TIMESTAMP) AS ts, {r('value', 'value')} FROM dma")
def dma_long(spark, sf_dir):
    return ind.displaced_averages(B.orders_daily(spark, sf_dir)).select("instrument", "metric", "ts", *rounded("value"))


def recursive(spark, sf_dir, *names):
    return affine_indicators(B.orders_daily(spark, sf_dir), names=names).select("instrument", "ts", *rounded(*names))


NUMBERED = f"{BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS rn FROM bars)"
STEP = lambda s: f"CAST(2.0 AS DOUBLE) / {s + 1}"


def sql_ema(expr: str, was: str, span: int) -> str:
    return f"{expr} * ({STEP(span)}) + {was} * (1 - {STEP(span)})"


@query(f"""WITH RECURSIVE {NUMBERED}, e AS (SELECT instrument, rn, ts, close AS ema9, close AS ema21, close AS ema55 FROM n WHERE rn = 1
UNION ALL SELECT n.instrument, n.rn, n.ts, {sql_ema('n.close', 'e.ema9', 9)}, {sql_ema('n.close', 'e.ema21', 21)}, {sql_ema('n.close', 'e.ema55', 55)} FROM e JOIN n ON n.instrument = e.instrument AND n.rn = e.rn + 1)
SELECT instrument, ts, {r('ema9', 'ema9')}, {r('ema21', 'ema21')}, {r('ema55', 'ema55')} FROM e""")
def ema(spark, sf_dir):
    return recursive(spark, sf_dir, "ema9", "ema21", "ema55")


@query(f"""WITH RECURSIVE {NUMBERED}, e AS (SELECT instrument, rn, ts, close AS a, close AS b, CAST(0 AS DOUBLE) AS s FROM n WHERE rn = 1
UNION ALL SELECT n.instrument, n.rn, n.ts, {sql_ema('n.close', 'e.a', 12)}, {sql_ema('n.close', 'e.b', 26)},
  {sql_ema('((' + sql_ema('n.close', 'e.a', 12) + ') - (' + sql_ema('n.close', 'e.b', 26) + '))', 'e.s', 9)} FROM e JOIN n ON n.instrument = e.instrument AND n.rn = e.rn + 1)
SELECT instrument, ts, {r('a - b', 'macd')}, {r('s', 'macd_signal')}, {r('a - b - s', 'macd_hist')} FROM e""")
def macd(spark, sf_dir):
    return recursive(spark, sf_dir, "macd", "macd_signal", "macd_hist")


@query(f"""WITH RECURSIVE {NUMBERED}, d AS (SELECT *, abs(close - lag(close, 10) OVER w) AS change, abs(close - lag(close) OVER w) AS step FROM n WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
k AS (SELECT *, sum(step) OVER {over(10)} AS travelled FROM d),
sc AS (SELECT *, pow((CASE WHEN travelled > 0 THEN change / travelled ELSE 0 END) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS speed FROM k),
e AS (SELECT instrument, rn, ts, close AS y FROM sc WHERE rn = 11 UNION ALL SELECT sc.instrument, sc.rn, sc.ts, e.y + sc.speed * (sc.close - e.y) FROM e JOIN sc ON sc.instrument = e.instrument AND sc.rn = e.rn + 1)
SELECT n.instrument, n.ts, {r('y', 'kama10')} FROM n LEFT JOIN e ON e.instrument = n.instrument AND e.rn = n.rn""")
def kama(spark, sf_dir):
    return recursive(spark, sf_dir, "kama10")


@query(f"""WITH RECURSIVE {NUMBERED}, t AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS before FROM n), tr AS (SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM t),
e AS (SELECT instrument, rn, ts, tr AS y FROM tr WHERE rn = 1 UNION ALL SELECT tr.instrument, tr.rn, tr.ts, tr.tr * (CAST(1.0 AS DOUBLE) / 14) + e.y * (1 - CAST(1.0 AS DOUBLE) / 14) FROM e JOIN tr ON tr.instrument = e.instrument AND tr.rn = e.rn + 1)
SELECT instrument, ts, {r('y', 'atr_wilder')} FROM e""")
def atr_wilder(spark, sf_dir):
    return recursive(spark, sf_dir, "atr_wilder")


@query(f"""WITH RECURSIVE {NUMBERED}, t AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS before FROM n),
tr AS (SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM t), a AS (SELECT *, {gate('avg', 'tr', 10)} AS atr FROM tr),
z AS (SELECT *, (high + low) / 2 + 3 * atr AS a, (high + low) / 2 - 3 * atr AS b FROM a WHERE atr IS NOT NULL),
e AS (SELECT instrument, rn, ts, a AS up, b AS low, 1 AS d FROM z WHERE rn = 10
UNION ALL SELECT z.instrument, z.rn, z.ts, CASE WHEN z.before <= e.up THEN least(z.a, e.up) ELSE z.a END, CASE WHEN z.before >= e.low THEN greatest(z.b, e.low) ELSE z.b END,
  CASE WHEN z.close > e.up THEN 1 WHEN z.close < e.low THEN -1 ELSE e.d END FROM e JOIN z ON z.instrument = e.instrument AND z.rn = e.rn + 1)
SELECT n.instrument, n.ts, {r('CASE WHEN d = 1 THEN e.low ELSE e.up END', 'supertrend')}, CAST(d AS INTEGER) AS supertrend_dir FROM n LEFT JOIN e ON e.instrument = n.instrument AND e.rn = n.rn""")
def supertrend(spark, sf_dir):
    rows = supertrend_of(B.orders_daily(spark, sf_dir))
    return rows.select("instrument", "ts", *rounded("supertrend"), "supertrend_dir")


SNAPSHOT = ("sma9", "sma21", "rsi14", "k14", "d3", "prediction", "williams14", "cci20", "atr14", "obv", "boll_mid", "donchian_high", "donchian_low", "vwap", "cmf20")
WIDE = f"""{BASE}, w AS (SELECT *, {gate('avg', 'close', 9)} AS sma9, {gate('avg', 'close', 21)} AS sma21, {gate('avg', 'gain', 14)} AS g, {gate('avg', 'loss', 14)} AS ls, {gate('max', 'high', 14)} AS hh, {gate('min', 'low', 14)} AS ll,
  {gate('avg', 'tp', 20)} AS m, list(tp) OVER {over(20)} AS l, {gate('avg', 'tr', 14)} AS atr14, sum(coalesce(sign(close - before) * volume, 0)) {ALL_BEFORE} AS obv, {gate('avg', 'close', 20)} AS boll_mid,
  {gate('max', 'high', 20)} AS donchian_high, {gate('min', 'low', 20)} AS donchian_low, sum(tp * volume) {ALL_BEFORE} / nullif(sum(volume) {ALL_BEFORE}, 0) AS vwap,
  coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mf FROM base),
v AS (SELECT *, CASE WHEN ls > 0 THEN 100 - 100 / (1 + g / ls) WHEN g > 0 THEN 100 END AS rsi14, 100 * (close - ll) / nullif(hh - ll, 0) AS k14, 100 * (close - hh) / nullif(hh - ll, 0) AS williams14,
  (tp - m) / nullif(0.015 * (list_sum(list_transform(l, lambda x: abs(x - m))) / 20), 0) AS cci20, sma9 - sma21 AS prediction, ({gate('sum', 'mf', 20)}) / nullif({gate('sum', 'volume', 20)}, 0) AS cmf20 FROM w),
f AS (SELECT *, {gate('avg', 'k14', 3)} AS d3, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS newest FROM v)"""


@query(f"WITH {WIDE} SELECT instrument, ts, metric, {r('value', 'value')} FROM (UNPIVOT (SELECT instrument, ts, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in SNAPSHOT)} FROM f WHERE newest = 1) ON {', '.join(SNAPSHOT)} INTO NAME metric VALUE value)")
def snapshot_long(spark, sf_dir):
    latest = ind.latest_indicators(B.orders_daily(spark, sf_dir)).select("instrument", "ts", *SNAPSHOT)
    return latest.unpivot(["instrument", "ts"], list(SNAPSHOT), "metric", "value").filter("value is not null").select("instrument", "ts", "metric", *rounded("value"))
