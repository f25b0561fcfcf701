"""Answers of data services, new keys, due work, signals and messages over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import indicators as ind
from tidemark.operators import relational as R
from tidemark.operators import strategy as T
from tidemark.plans.indicator_queries import BARS, BASE, gate, r, rounded
from tidemark.plans.registry import query
from tidemark.runtime import table
from tidemark.sources import bars as B
from tidemark.sources import connectors as C

DAYS = "SELECT o_orderstatus AS instrument, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, max(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY 1, 2"


def days(spark, sf_dir):
    day = F.date_trunc("day", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("instrument"), day.cast("timestamp").alias("ts")).agg(F.max("o_totalprice").alias("x"), F.count(F.lit(1)).alias("n"))


def pages(rows, bar):
    """One JSON page of arrays for each instrument and year, and the year's last bar on the next page too."""
    rows = rows.withColumn("page", F.explode(F.when(F.month("ts") == 12, F.array(F.year("ts"), F.year("ts") + 1)).otherwise(F.array(F.year("ts")))))
    return rows.groupBy("instrument", "page").agg(F.to_json(F.collect_list(bar)).alias("body"))


@query(f"WITH d AS ({DAYS}) SELECT instrument, ts, x AS open, x AS high, x AS low, x AS close, CAST(n AS DOUBLE) AS volume, CAST(0 AS BIGINT) AS trades FROM d")
def candle_arrays(spark, sf_dir):
    """Arrays of six numbers, time in milliseconds."""
    bar = F.array(F.unix_millis("ts").cast("double").cast("decimal(20,0)").cast("string"), *[F.col("x").cast("string")] * 4, F.col("n").cast("string"))
    return C.array_bars(pages(days(spark, sf_dir), bar))


@query(f"WITH d AS ({DAYS}) SELECT instrument, ts, x AS open, x AS high, x AS low, x AS close, CAST(n AS DOUBLE) AS volume, n AS trades FROM d")
def kline_arrays(spark, sf_dir):
    """Arrays of twelve strings; the ninth is the number of trades."""
    text = lambda c: F.col(c).cast("string")
    bar = F.array(F.unix_millis("ts").cast("string"), *[text("x")] * 4, text("n"), F.lit("0"), F.lit("0"), text("n"), F.lit("0"), F.lit("0"), F.lit("0"))
    return C.array_bars(pages(days(spark, sf_dir), bar))


@query(f"WITH {BARS} SELECT instrument, ts, open, high, low, close, volume, CAST(0 AS BIGINT) AS trades FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 730 DAY")
def titled_frame(spark, sf_dir):
    bars = B.orders_daily(spark, sf_dir)
    titled = bars.select("instrument", "ts", *[F.col(c).alias(c.title()) for c in C.PRICES])
    return C.within_history(C.frame_bars(titled), "1h", bars.agg(F.max("ts")).scalar())


@query("""SELECT o_orderstatus AS instrument, CAST(to_timestamp(CAST(epoch(o_orderdate) AS BIGINT)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts, CAST(o_orderkey AS DOUBLE) AS open, CAST(o_custkey AS DOUBLE) AS high,
CAST(0 AS DOUBLE) AS low, CAST(o_orderkey AS DOUBLE) AS close, CAST(o_custkey % 100 AS DOUBLE) AS volume FROM orders""")
def record_maps(spark, sf_dir):
    """Records as maps: half with lower-case keys and a time string, half titled with epoch seconds."""
    key, cust, small = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "small"))
    lower = F.create_map(F.lit("timestamp"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("open"), key, F.lit("high"), cust, F.lit("close"), key, F.lit("volume"), small)
    titled = F.create_map(F.lit("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("Open"), key, F.lit("High"), cust, F.lit("Close"), key, F.lit("Volume"), small)
    orders = table(spark, sf_dir, "orders").withColumn("small", F.col("o_custkey") % 100)
    return C.record_bars(orders.select(F.col("o_orderstatus").alias("instrument"), F.when(F.col("o_orderkey") % 2 == 0, lower).otherwise(titled).alias("fields")))


ANSWERS = (
    '{"status": "ok", "data": []}', '{"status": "error", "err-code": "bad-symbol", "err-msg": "no such"}', '{"code": 200}', '{"code": 1002, "message": "denied"}', '{"success": true}',
    '{"success": false, "message": "later"}', '{"data": 1}', '{"status": "maintenance"}',
)
FAULTS = (None, "bad-symbol: no such", None, "1002: denied", None, "later", "no status", "unexpected status maintenance")


@query(f"""SELECT k AS answer, k IN ({', '.join(str(k) for k, f in enumerate(FAULTS) if f is None)}) AS accepted, [{', '.join(f"'{f}'" if f else 'NULL' for f in FAULTS)}][k + 1] AS fault, n
FROM (SELECT event_id % {len(ANSWERS)} AS k, count(*) AS n FROM events GROUP BY 1)""")
def answer_gate(spark, sf_dir):
    """Accepted and refused answers, by kind of answer."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % len(ANSWERS)).alias("answer"))
    rows = rows.withColumn("body", F.get(F.array(*map(F.lit, ANSWERS)), F.col("answer")))
    return C.judged(rows).groupBy("answer", "accepted", "fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT upper(c_mktsegment) || 'USDT' AS symbol FROM customer WHERE c_acctbal > 0 AND c_nationkey % 2 = 0")
def listed_symbols(spark, sf_dir):
    quote = F.when(F.col("c_nationkey") % 2 == 0, "usdt").otherwise("btc").alias("quote")
    return C.listed(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("base"), quote, (F.col("c_acctbal") > 0).alias("active")))


@query("SELECT n_nationkey, n_name, vol FROM nation JOIN (SELECT c_nationkey, sum(greatest(round(c_acctbal), 0)) AS vol FROM customer GROUP BY 1) ON c_nationkey = n_nationkey WHERE vol <> 0")
def symbols_with_volume(spark, sf_dir):
    """Nations with the volume of all their customers."""
    nation = table(spark, sf_dir, "nation")
    volumes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.greatest(F.round("c_acctbal"), F.lit(0.0))).alias("vol"))
    tickers = nation.join(volumes, F.col("n_nationkey") == F.col("c_nationkey")).select(F.lower("n_name").alias("symbol"), "vol")
    return C.with_volume(nation.select("n_nationkey", "n_name", F.upper("n_name").alias("symbol")), tickers).select("n_nationkey", "n_name", "vol")


@query("""WITH s AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0),
f AS (SELECT lower(n_name) AS low, min(n_name) AS name FROM nation WHERE n_nationkey % 2 = 1 GROUP BY 1 UNION ALL SELECT DISTINCT lower(c_name), c_name FROM customer)
SELECT CAST(id AS BIGINT) AS id, name FROM s UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY low), name FROM f""")
def get_or_create_ids(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    names = nation.select("name").unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))
    return R.with_new_ids(names, nation.filter("id % 2 = 0"), "name", "id")


@query("""WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY 1)
SELECT event_id, user_id, ts FROM events LEFT JOIN m USING (user_id) WHERE mark IS NULL OR ts > mark""")
def newer_than_mark(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return R.newer_than_mark(events, events.filter("event_id % 2 = 0 and user_id % 3 <> 0"), "user_id", "ts")


CODES = ", ".join(f"('{c}', {float(S.HISTORY_YEARS.get(c, 2.0))}, {S.REFRESH_SECONDS[c]})" for c, _ in S.TIMEFRAMES)


@query(f"SELECT code, CAST(years AS DOUBLE) AS years, CAST(seconds AS INTEGER) AS seconds FROM (VALUES {CODES}) AS t(code, years, seconds)")
def timeframe_rules(spark, sf_dir):
    return S.timeframes(spark).select("code", S.history_years(F.col("code")).alias("years"), S.refresh_seconds(F.col("code")).alias("seconds"))


@query("""SELECT o_orderkey, CASE WHEN epoch(o_orderdate) > 946656000 THEN CAST(epoch(o_orderdate) AS BIGINT) * 1000 - 28800000 ELSE CAST(0 AS BIGINT) END AS from_seconds,
CASE WHEN epoch_ms(o_orderdate) > 946656000000 THEN CAST(epoch_ms(o_orderdate) AS BIGINT) - 28800000 ELSE CAST(0 AS BIGINT) END AS from_millis,
CASE o_orderkey % 3 WHEN 0 THEN 'System error' WHEN 1 THEN 'Invalid ETF name' ELSE '' END AS meaning,
'<b>' || o_orderstatus || '</b> ' || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' END, 'N/A') || ' #' || o_orderkey AS message FROM orders""")
def messages(spark, sf_dir):
    """Clock shift (0 up to the year 2000), meanings of error codes and filled message templates."""
    at = F.col("o_orderdate").cast("timestamp")
    code = F.when(F.col("o_orderkey") % 3 == 0, 13500).when(F.col("o_orderkey") % 3 == 1, 10400).otherwise(200)
    text = S.filled("<b>{symbol}</b> {side} #{id}", symbol=F.col("o_orderstatus"), side=F.when(F.col("o_orderkey") % 2 == 0, "BUY"), id=F.col("o_orderkey"))
    shifted = S.beijing_seconds_to_utc_millis(F.unix_seconds(at)).alias("from_seconds"), S.beijing_millis_to_utc_millis(F.unix_millis(at)).alias("from_millis")
    return table(spark, sf_dir, "orders").select("o_orderkey", *shifted, C.fund_error(code).alias("meaning"), text.alias("message"))


HOURLY = """bars AS (SELECT event_type AS instrument, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


@query(f"""WITH {BASE.replace(BARS, HOURLY)}, g AS (SELECT *, {gate('avg', 'gain', 14)} AS g, {gate('avg', 'loss', 14)} AS l FROM base),
x AS (SELECT instrument, ts, close, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END AS rsi FROM g),
s AS (SELECT *, CASE WHEN rsi < 40 THEN 'BUY' WHEN rsi > 60 THEN 'SELL' END AS side FROM x), p AS (SELECT *, lag(side) OVER (PARTITION BY instrument ORDER BY ts) AS before FROM s)
SELECT instrument, ts, {r('close', 'price')}, side FROM p WHERE side IS NOT NULL AND side IS DISTINCT FROM before""")
def threshold_signals(spark, sf_dir):
    """Bars of hourly values where the RSI enters the zones under 40 and over 60."""
    return T.threshold_signals(B.events_hourly(spark, sf_dir), low=40.0, high=60.0).select("instrument", "ts", *rounded("price"), "side")


@query("SELECT event_type, round(sum(value) / (count(*) + 1), 3) AS cost FROM events GROUP BY 1 ORDER BY cost DESC")
def mean_cost(spark, sf_dir):
    """Mean cost by kind, dearest first; the divisor has an offset of one call."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value") / (F.count(F.lit(1)) + 1), 3).alias("cost")).orderBy(F.desc("cost"))


COLUMNS = "orders", "customer", "events"


@query(f"SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS place FROM information_schema.columns WHERE table_name IN {COLUMNS}")
def table_columns(spark, sf_dir):
    """Columns of stored tables, from their schemas alone."""
    rows = [(t, c, i) for t in COLUMNS for i, c in enumerate(table(spark, sf_dir, t).columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int")
