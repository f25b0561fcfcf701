"""Queries over bars of several timeframes in one table, the stored metrics, and updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.rolling import KEY, sma
from tidemark.operators import indicators as ind
from tidemark.operators import updates as U
from tidemark.operators.recursive import affine_indicators
from tidemark.plans.indicator_queries import BARS, STEP, gate, r, rounded, sql_ema
from tidemark.plans.registry import query
from tidemark.runtime import work_dir
from tidemark.sources import bars as B
from tidemark.sources import store

#: Daily and weekly bars of order prices.
FRAMES = BARS.replace("bars AS (", "days AS (", 1) + """, weeks AS (SELECT instrument, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM days GROUP BY 1, 2),
bars AS (SELECT instrument, '1d' AS timeframe, * EXCLUDE (instrument) FROM days UNION ALL SELECT instrument, '1w' AS timeframe, * EXCLUDE (instrument) FROM weeks)"""


def keyed(sql: str) -> str:
    """SQL over series of one timeframe, for several."""
    return sql.replace("PARTITION BY instrument", "PARTITION BY instrument, timeframe")


@query(f"WITH {FRAMES} SELECT instrument, timeframe, ts, {r(keyed(gate('avg', 'close', 9)), 'sma9')} FROM bars")
def sma_of_frames(spark, sf_dir):
    return B.orders_daily_and_weekly(spark, sf_dir).withColumn("sma9", sma(F.col("close"), 9)).select(*KEY, "ts", *rounded("sma9"))


DMA = f"""s AS (SELECT *, min(ts) OVER (PARTITION BY instrument, timeframe) AS t0, nth_value(ts, 2) OVER (PARTITION BY instrument, timeframe ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t1 FROM bars),
x AS (SELECT s.*, p, d FROM s, (VALUES {', '.join(map(str, ind.DMA_COMBINATIONS))}) AS c(p, d) WHERE t1 IS NOT NULL),
y AS (SELECT instrument, timeframe, p, d, ts + (t1 - t0) * d AS ts, CASE {' '.join(f'WHEN p = {p} THEN ' + keyed(gate('avg', 'close', p)).replace('timeframe ORDER', 'timeframe, p ORDER') for p, _ in ind.DMA_COMBINATIONS)} END AS value FROM x),
dma AS (SELECT instrument, timeframe, p, d, CAST(ts AS TIMESTAMP) AS ts, value FROM y WHERE value IS NOT NULL)"""


def stored_metrics(spark, sf_dir):
    """A new table with the displaced averages of all series: appended twice over, then upserted."""
    table = store.metrics(f"{work_dir(spark)}/metrics-{uuid.uuid4().hex}").create(spark)
    rows = store.with_parts(ind.displaced_averages(B.orders_daily_and_weekly(spark, sf_dir)))
    table.append(rows.filter("period = 3").withColumn("value", F.lit(0.0)))
    table.upsert(rows)
    return table


@query(f"WITH {FRAMES}, {DMA} SELECT instrument, timeframe, 'DMA' AS metric, p AS period, d AS displacement, ts, {r('value', 'value')} FROM dma")
def metrics_upserted(spark, sf_dir):
    """Metrics written, written again with other values, and read back."""
    return stored_metrics(spark, sf_dir).rows(spark).select(*KEY, "metric", "period", "displacement", "ts", *rounded("value"))


@query(f"WITH {FRAMES}, {DMA} SELECT ts, {r('value', 'value')} FROM dma WHERE instrument = '1-URGENT' AND timeframe = '1w' AND p = 7 AND d = 5 ORDER BY ts")
def metrics_by_key(spark, sf_dir):
    """One series' metric read back by its five keys, in order of time."""
    found = stored_metrics(spark, sf_dir).read(spark, instrument="1-URGENT", timeframe="1w", metric="DMA", period=7, displacement=5)
    return found.select("ts", *rounded("value")).orderBy("ts")


@query(f"WITH {FRAMES}, {DMA} SELECT instrument, timeframe, max(ts) AS last_ts FROM dma GROUP BY 1, 2")
def metrics_latest(spark, sf_dir):
    return stored_metrics(spark, sf_dir).latest(spark)


SHOWN = " ".join(f"WHEN '{code}' THEN {n}" for code, n in S.SHOWN.items())


@query(f"WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, timeframe ORDER BY ts DESC) AS rn FROM bars) SELECT instrument, timeframe, ts, close FROM n WHERE rn <= CASE timeframe {SHOWN} ELSE 500 END")
def shown_by_frame(spark, sf_dir):
    """The newest bars of each series, as many as a chart of its timeframe shows."""
    return U.shown_bars(B.orders_daily_and_weekly(spark, sf_dir)).select(*KEY, "ts", "close")


CUT = "instrument <> '1-URGENT' AND ts < (SELECT max(ts) FROM bars WHERE timeframe = '1d') - (CASE instrument WHEN '2-HIGH' THEN 500 ELSE 20 END) * INTERVAL 1 DAY"
DAYS = " ".join(f"WHEN '{code}' THEN {n}" for code, n in S.BACKFILL_DAYS.items())


@query(f"""WITH {FRAMES}, stored AS (SELECT * FROM bars WHERE {CUT}), mark AS (SELECT instrument, timeframe, max(ts) AS mark FROM stored GROUP BY 1, 2),
now AS (SELECT max(ts) AS now FROM bars WHERE timeframe = '1d'), o AS (SELECT b.*, mark, now, row_number() OVER (PARTITION BY b.instrument, b.timeframe ORDER BY b.ts DESC) AS rn FROM bars b LEFT JOIN mark USING (instrument, timeframe), now),
fresh AS (SELECT * FROM o WHERE CASE WHEN mark IS NULL THEN rn <= 100 ELSE ts > mark AND ts > now - (CASE timeframe {DAYS} ELSE 365 END) * INTERVAL 1 DAY END),
whole AS (SELECT instrument, timeframe, ts, close FROM stored UNION ALL SELECT instrument, timeframe, ts, close FROM fresh)
SELECT instrument, timeframe, ts, {r(keyed(gate('avg', 'close', 3)), 'dma3')} FROM whole WHERE EXISTS (SELECT 1 FROM fresh f WHERE f.instrument = whole.instrument AND f.timeframe = whole.timeframe)""")
def update_pass(spark, sf_dir):
    """An update of all series: what is missing since their last bars (at most so many days back, and the
    last hundred of a new series) is inserted, and touched series' averages are computed again."""
    offered = B.orders_daily_and_weekly(spark, sf_dir)
    now = offered.filter("timeframe = '1d'").agg(F.max("ts").alias("now"))
    old = F.when(F.col("instrument") == "2-HIGH", 500).otherwise(20)
    stored = offered.filter((F.col("instrument") != "1-URGENT") & (F.col("ts") < now.scalar() - F.make_dt_interval(old)))
    fresh = U.missing_bars(offered, stored, now)
    whole = U.of_touched(stored.unionByName(fresh.select(*stored.columns)), fresh)
    return whole.withColumn("dma3", sma(F.col("close"), 3)).select(*KEY, "ts", *rounded("dma3"))


NUMBERED = f"{FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, timeframe ORDER BY ts) AS rn FROM bars)"


@query(f"""WITH RECURSIVE {NUMBERED}, e AS (SELECT instrument, timeframe, rn, ts, close AS a, close AS b, CAST(0 AS DOUBLE) AS s FROM n WHERE rn = 1
UNION ALL SELECT n.instrument, n.timeframe, n.rn, n.ts, {sql_ema('n.close', 'e.a', 12)}, {sql_ema('n.close', 'e.b', 26)},
  {sql_ema('((' + sql_ema('n.close', 'e.a', 12) + ') - (' + sql_ema('n.close', 'e.b', 26) + '))', 'e.s', 9)} FROM e JOIN n ON n.instrument = e.instrument AND n.timeframe = e.timeframe AND n.rn = e.rn + 1)
SELECT instrument, timeframe, ts, {r('a - b', 'macd')}, {r('s', 'macd_signal')}, {r('a - b - s', 'macd_hist')} FROM e""")
def macd_of_frames(spark, sf_dir):
    """Recurrences with series cut into short chunks."""
    out = affine_indicators(B.orders_daily_and_weekly(spark, sf_dir), chunk=512, names=("macd", "macd_signal", "macd_hist"))
    return out.select(*KEY, "ts", *rounded("macd", "macd_signal", "macd_hist"))


@query(f"""WITH RECURSIVE {NUMBERED}, l AS (SELECT *, lag(close) OVER w AS before, abs(close - lag(close, 14) OVER w) AS change, (high + low + close) / 3 AS tp FROM n WINDOW w AS (PARTITION BY instrument, timeframe ORDER BY ts)),
base AS (SELECT *, abs(close - before) AS step, greatest(coalesce(close - before, 0), 0) AS gain, greatest(coalesce(before - close, 0), 0) AS loss, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM l),
w AS (SELECT *, {keyed(', '.join(f"{gate(f, x, k)} AS {name}" for f, x, k, name in (('avg', 'close', 14, 'sma14'), ('avg', 'close', 50, 'sma50'), ('avg', 'close', 9, 'sma9'), ('avg', 'close', 21, 'sma21'), ('avg', 'gain', 14, 'g'), ('avg', 'loss', 14, 'ls'), ('max', 'high', 14, 'hh'), ('min', 'low', 14, 'll'), ('avg', 'tp', 20, 'm'), ('avg', 'tr', 14, 'atr14'))))},
  list(tp) OVER (PARTITION BY instrument, timeframe ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tps, sum(coalesce(sign(close - before) * volume, 0)) OVER (PARTITION BY instrument, timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv,
  max(high) OVER (PARTITION BY instrument, timeframe ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS top, min(low) OVER (PARTITION BY instrument, timeframe ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS bottom,
  sum(step) OVER (PARTITION BY instrument, timeframe ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS travelled FROM base),
v AS (SELECT *, 100 * (close - ll) / nullif(hh - ll, 0) AS k14, pow((CASE WHEN travelled > 0 THEN change / travelled ELSE 0 END) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS speed FROM w),
d AS (SELECT *, {keyed(gate('avg', 'k14', 3))} AS d3 FROM v),
e AS (SELECT instrument, timeframe, rn, close AS e9, close AS a, close AS b, CAST(0 AS DOUBLE) AS s FROM n WHERE rn = 1
UNION ALL SELECT n.instrument, n.timeframe, n.rn, {sql_ema('n.close', 'e.e9', 9)}, {sql_ema('n.close', 'e.a', 12)}, {sql_ema('n.close', 'e.b', 26)},
  {sql_ema('((' + sql_ema('n.close', 'e.a', 12) + ') - (' + sql_ema('n.close', 'e.b', 26) + '))', 'e.s', 9)} FROM e JOIN n ON n.instrument = e.instrument AND n.timeframe = e.timeframe AND n.rn = e.rn + 1),
y AS (SELECT instrument, timeframe, rn, close AS ama FROM v WHERE rn = 15 UNION ALL SELECT v.instrument, v.timeframe, v.rn, y.ama + v.speed * (v.close - y.ama) FROM y JOIN v ON v.instrument = y.instrument AND v.timeframe = y.timeframe AND v.rn = y.rn + 1),
f AS (SELECT d.*, e9, a, b, s, ama FROM d JOIN e USING (instrument, timeframe, rn) LEFT JOIN y USING (instrument, timeframe, rn) QUALIFY row_number() OVER (PARTITION BY instrument, timeframe ORDER BY ts DESC) = 1),
z AS (SELECT instrument, timeframe, ts, unnest([{{'metric': 'SMA 14', 'value': sma14}}, {{'metric': 'SMA 50', 'value': sma50}}, {{'metric': 'EMA 9', 'value': e9}}, {{'metric': 'RSI 14', 'value': CASE WHEN ls > 0 THEN 100 - 100 / (1 + g / ls) WHEN g > 0 THEN 100 END}},
  {{'metric': 'AMA 14', 'value': ama}}, {{'metric': 'MACD', 'value': a - b}}, {{'metric': 'Signal Line', 'value': s}}, {{'metric': 'MACD Histogram', 'value': a - b - s}}, {{'metric': 'Stochastic %K', 'value': k14}}, {{'metric': 'Stochastic %D', 'value': d3}},
  {{'metric': 'Prediction Signal', 'value': sma9 - sma21}}, {{'metric': 'OP', 'value': close}}, {{'metric': 'XOP', 'value': high + 1.618 * (high - low)}}, {{'metric': 'COP', 'value': high - 0.5 * (high - low)}},
  {{'metric': 'Support', 'value': bottom + (top - bottom) * 0.618}}, {{'metric': 'Resistance', 'value': top - (top - bottom) * 0.618}}, {{'metric': 'CCI', 'value': (tp - m) / nullif(0.015 * (list_sum(list_transform(tps, lambda x: abs(x - m))) / 20), 0)}},
  {{'metric': 'OBV', 'value': obv}}, {{'metric': 'ATR', 'value': atr14}}, {{'metric': 'Williams %R', 'value': 100 * (close - hh) / nullif(hh - ll, 0)}}]) AS x FROM f)
SELECT instrument, timeframe, ts, x.metric AS metric, {r('x.value', 'value')} FROM z WHERE x.value IS NOT NULL""")
def snapshot_named(spark, sf_dir):
    """The latest value of each of the twenty named metrics of every series, as rows."""
    return ind.named_snapshot(B.orders_daily_and_weekly(spark, sf_dir)).select(*KEY, "ts", "metric", *rounded("value"))
