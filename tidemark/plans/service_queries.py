"""Requests, answers, accounts, checks, strategies and looks at tables, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY
from tidemark.functions.scalars import TIMEFRAMES, coalesced_name
from tidemark.operators import relational as R
from tidemark.operators import strategy as T
from tidemark.plans.frame_queries import DMA, FRAMES, stored_metrics
from tidemark.plans.indicator_queries import BARS, r, rounded
from tidemark.plans.registry import query
from tidemark.plans.series_queries import CROSS, exits_sql
from tidemark.runtime import table, work_dir
from tidemark.sources import bars as B
from tidemark.sources import connectors as C
from tidemark.sources import folder, store
from tidemark.sources import messages as M


@query(f"WITH {FRAMES}, {DMA} SELECT metric, period, {r('value', 'value')} FROM (SELECT 'DMA' AS metric, * RENAME (p AS period) FROM dma) WHERE instrument = '5-LOW' AND timeframe = '1w'")
def metrics_of_series(spark, sf_dir):
    """What is stored for one series and kind, by three keys."""
    return stored_metrics(spark, sf_dir).read(spark, instrument="5-LOW", timeframe="1w", metric="DMA").select("metric", "period", *rounded("value"))


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def table_sample(spark, sf_dir):
    return folder.sample(table(spark, sf_dir, "part"), "p_partkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice >= 100000.0")
def parameterised(spark, sf_dir):
    sql = "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderpriority = :priority AND o_totalprice >= :least"
    return R.run_sql(spark, sql, {"priority": "2-HIGH", "least": 100000.0}, orders=table(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE o_orderdate END AS o_orderdate FROM orders")
def update_where(spark, sf_dir):
    """A new time in the rows of two keys."""
    orders = table(spark, sf_dir, "orders")
    return R.updated(orders, (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0), "o_orderdate", F.lit("2024-01-01")).select("o_orderkey", "o_orderdate")


@query(f"""WITH {FRAMES}, now AS (SELECT max(ts) AS now FROM bars WHERE timeframe = '1d'), n AS (SELECT bars.*, row_number() OVER (PARTITION BY instrument, timeframe ORDER BY ts DESC) AS rn FROM bars, now WHERE ts >= now - INTERVAL 61 DAY)
SELECT instrument, timeframe, ts, close FROM n WHERE rn <= 60""")
def recent_page(spark, sf_dir):
    """The last sixty bars of each series that one request gives."""
    bars = B.orders_daily_and_weekly(spark, sf_dir)
    return C.recent_bars(bars, 60, bars.filter("timeframe = '1d'").agg(F.max("ts")).scalar()).select(*KEY, "ts", "close")


@query(f"WITH {BARS} SELECT instrument, ts, close FROM bars WHERE ts BETWEEN (SELECT max(ts) FROM bars) - INTERVAL 730 DAY AND (SELECT max(ts) FROM bars)")
def default_window(spark, sf_dir):
    bars = B.orders_daily(spark, sf_dir)
    return C.within_years(bars, bars.agg(F.max("ts")).scalar()).select("instrument", "ts", "close")


@query("""SELECT o_orderstatus || o_orderkey AS symbol, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow' AS local_ts, 0.5 AS low, CAST(o_custkey AS DOUBLE) AS high, 1.5 AS open, CAST(o_orderkey AS DOUBLE) AS close, 2.5 AS volume, 3.5 AS amount FROM orders WHERE o_orderkey % 3 <> 0""")
def snapshot_ticks(spark, sf_dir):
    """Snapshots with a tick as rows on the display zone's clock; every third has none."""
    orders = table(spark, sf_dir, "orders")
    tick = F.struct(F.lit(0.5).alias("low"), F.col("o_custkey").alias("high"), F.lit(1.5).alias("open"), F.col("o_orderkey").alias("close"), F.lit(2.5).alias("vol"), F.lit(3.5).alias("amount"))
    body = F.to_json(F.struct(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.when(F.col("o_orderkey") % 3 != 0, tick).alias("tick")))
    return M.tick_row(orders.select(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("symbol"), body.alias("body")))


@query("SELECT n_name AS symbol, arg_max(c_acctbal, c_custkey) AS close FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def latest_prices(spark, sf_dir):
    """The newest ticker's close of every symbol, null where there is none."""
    nation = table(spark, sf_dir, "nation")
    tickers = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return M.latest_prices(nation.select(F.col("n_name").alias("symbol")), tickers.select(F.upper("n_name").alias("symbol"), F.col("c_custkey").alias("ts"), F.col("c_acctbal").alias("close")))


KINDS = {"BUILDING": "spot", "AUTOMOBILE": "margin", "MACHINERY": "otc"}
KIND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())


def accounts(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(F.try_element_at(kind, F.col("c_mktsegment")), F.lit("point")).alias("type"), (F.col("c_nationkey") % 5).cast("string").alias("subtype"))


@query(f"""WITH a AS (SELECT c_custkey AS id, CASE c_mktsegment {KIND_SQL} ELSE 'point' END AS type, CAST(c_nationkey % 5 AS VARCHAR) AS subtype FROM customer)
(SELECT * FROM a WHERE type = 'spot' ORDER BY id LIMIT 1) UNION ALL (SELECT * FROM a WHERE type = 'margin' AND subtype = '3' ORDER BY id LIMIT 1) UNION ALL (SELECT * FROM a WHERE type = 'point' ORDER BY id LIMIT 1)""")
def account_by_type(spark, sf_dir):
    """The first account of a type; a margin account's symbol must fit too."""
    rows = accounts(spark, sf_dir)
    return M.account_of(rows, "spot", "3").unionByName(M.account_of(rows, "margin", "3")).unionByName(M.account_of(rows, "point"))


@query("SELECT o_custkey AS id, o_orderkey AS currency, o_totalprice AS balance FROM orders WHERE o_totalprice > 300000.0")
def sufficient_balances(spark, sf_dir):
    """Entries over a balance, of accounts with lists of them."""
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("currency"), F.col("o_totalprice").alias("balance"))).alias("entries"))
    return M.sufficient(lists, 300000.0).select("id", F.inline("entries"))


@query("""SELECT event_id, '{"sub":"market.' || event_type || '.kline.1min","id":"' || event_id || '"}' AS kline, '{"req":"market.' || event_type || '.kline.1day","id":"' || event_id || '","from":' || user_id || '}' AS once,
'{"sub":"market.' || event_type || '.mbp.refresh.20","id":"' || event_id || '"}' AS book, '{"action":"sub","ch":"trade.clearing#' || event_type || '#1"}' AS clearing, '{"op":"req","topic":"orders.detail","cid":"' || event_id || '","order-id":"' || user_id || '"}' AS topic FROM events""")
def request_messages(spark, sf_dir):
    """Subscriptions, requests and topics as JSON."""
    symbol, at = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", M.market_message("kline", at, symbol=symbol, interval=F.lit("1min")).alias("kline"), M.market_message("kline", at, once=True, since=F.col("user_id"), symbol=symbol, interval=F.lit("1day")).alias("once"),
        M.market_message("mbp_full", at, symbol=symbol, levels=F.lit(20)).alias("book"), M.account_message("clearing", symbol=symbol, mode=F.lit(1)).alias("clearing"),
        M.topic_message("order", at, order_id=F.col("user_id").cast("string")).alias("topic"),
    )


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS DOUBLE) END AS bid, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS BIGINT) END AS quote_time FROM events")
def parsed_records(spark, sf_dir):
    """Records read by the schema of their kind, keys with - renamed; every seventh can't be read."""
    body = F.when(F.col("event_id") % 7 == 0, "no json").otherwise(F.concat(F.lit('{"ch": "x", "tick": {"quote-time": '), F.col("user_id").cast("string"), F.lit(', "bid": '), F.col("event_id").cast("string"), F.lit("}}")))
    records = M.RECORDS | {"quote": "quote_time bigint, bid double"}
    return M.parsed(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "quote", records=records).select("event_id", "record.bid", "record.quote_time")


@query("""SELECT n_nationkey, NOT regexp_matches(n_name, '[ _.]') AS symbol, n_nationkey % 2 = 0 OR NOT regexp_matches(n_name, '[ _.]') AS symbols, n_nationkey BETWEEN 3 AND 20 AS in_range, n_name IS NOT NULL AS present, n_name IS NULL AS absent,
n_regionkey IN (0, 2) AS in_list, n_nationkey % 2 = 0 AS of_length, n_nationkey >= 5 AS at_least, NOT (n_nationkey % 2 = 0 AND n_regionkey % 2 = 0) AS time_in_force, n_nationkey % 2 = 1 AS is_date, CASE WHEN n_nationkey % 2 = 1 THEN '2024-02-0' || (n_nationkey % 9 + 1) END AS date FROM nation""")
def request_checks(spark, sf_dir):
    """The checks of request values, as columns."""
    name, key, even = F.col("n_name"), F.col("n_nationkey"), F.col("n_nationkey") % 2 == 0
    lists, date = F.when(even, F.array(F.lit("btcusdt"))).otherwise(F.array(name, name)), F.when(even, "2024-02-31").otherwise(F.concat(F.lit("2024-2-"), (key % 9 + 1).cast("string")))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", M.valid_name(name).alias("symbol"), M.valid_names(lists).alias("symbols"), M.in_range(key, 3, 20).alias("in_range"), name.isNotNull().alias("present"), name.isNull().alias("absent"),
        M.in_list(F.col("n_regionkey"), 0, 2).alias("in_list"), M.of_length(lists, 1, 1).alias("of_length"), M.at_least(key, 5).alias("at_least"),
        M.valid_time_in_force(F.when(F.col("n_regionkey") % 2 == 0, "gtc").otherwise("ioc"), F.when(even, "buy-market").otherwise("buy-limit")).alias("time_in_force"),
        M.formatted_date(date).isNotNull().alias("is_date"), M.formatted_date(date).alias("date"),
    )


FRAME_OF = ["'1m'", "'7h'", "'1d'", "NULL"]


@query(f"SELECT event_id, code FROM (SELECT event_id, [{', '.join(FRAME_OF)}][event_id % 4 + 1] AS code FROM events) WHERE code IN ({', '.join(f"'{c}'" for c, _ in TIMEFRAMES)})")
def supported_frames(spark, sf_dir):
    """Work of supported timeframes; other codes go."""
    code = F.get(F.array(F.lit("1m"), F.lit("7h"), F.lit("1d"), F.lit(None)), F.col("event_id") % 4)
    return table(spark, sf_dir, "events").select("event_id", code.alias("code")).filter(F.col("code").isin([c for c, _ in TIMEFRAMES]))


@query("SELECT count(*) AS n, count(*) FILTER (year(o_orderdate) < 2000) AS suspicious FROM orders")
def suspicious_dates(spark, sf_dir):
    """Rows with a date before a year are counted, not dropped."""
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.year("o_orderdate") < 2000).alias("suspicious"))


@query("SELECT n_name AS symbol, r_name AS currency, count(c_custkey) AS listings FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def exchange_info(spark, sf_dir):
    """Symbols with their currencies, and the number of listings of each."""
    listings = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("listings"))
    symbols = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(listings, "n_nationkey", "left")
    return symbols.select(F.col("n_name").alias("symbol"), F.col("r_name").alias("currency"), F.coalesce("listings", F.lit(0)).cast("long").alias("listings"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'interval' WHEN 'O' THEN 'name' ELSE 'code' END AS timeframe FROM orders")
def frame_names(spark, sf_dir):
    """The name of a timeframe by the first of three fields that is there."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", coalesced_name(F.when(s == "F", "interval"), F.when(s == "O", "name"), F.lit("code")).alias("timeframe"))


RANKED = "WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)"


@query(f"""SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate)) AS INTEGER) AS rank, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate)) AS INTEGER) AS dense_rank, CAST(ntile(4) OVER w AS INTEGER) AS quartile,
round(percent_rank() OVER w, 9) AS percent_rank, lead(o_orderkey) OVER w AS next, first_value(o_orderkey) OVER w AS first,
count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS month_before FROM orders {RANKED}""")
def ranked_orders(spark, sf_dir):
    """Ranks, tiles, neighbours and a frame by range of time."""
    by = Window.partitionBy("o_orderpriority")
    w, years = by.orderBy(F.col("o_totalprice").desc(), "o_orderkey"), by.orderBy(F.year("o_orderdate"))
    month = by.orderBy(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).rangeBetween(-30 * 86400, 0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(years).alias("rank"), F.dense_rank().over(years).alias("dense_rank"), F.ntile(4).over(w).alias("quartile"), F.round(F.percent_rank().over(w), 9).alias("percent_rank"),
        F.lead("o_orderkey").over(w).alias("next"), F.first("o_orderkey").over(w).alias("first"), F.count(F.lit(1)).over(month).alias("month_before"),
    )


@query("SELECT o_orderkey, k AS level, round(o_totalprice * (1 - k / 100.0), 4) AS price FROM orders, (VALUES (0), (1), (2)) AS v(k)")
def level_rows(spark, sf_dir):
    """Price levels of each order by a table function."""
    spark.udtf.register("tidemark_levels", PriceLevels)
    return R.run_sql(spark, "SELECT o_orderkey, level, round(price, 4) AS price FROM {orders}, LATERAL tidemark_levels(o_totalprice, 3)", {}, orders=table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))


@F.udtf(returnType="level int, price double")
class PriceLevels:
    """Levels of a price, one per cent apart."""

    def eval(self, price: float, n: int):
        for k in range(n):
            yield k, price * (1 - k / 100.0)


STRATEGIES = [T.line_breakout_strategy("up", take_profit=0.2, stop_loss=0.1), T.line_breakout_strategy("down", "down", 0.15, 0.1), T.rectangle_strategy("range", take_profit=0.15), T.rectangle_strategy("gone")]


@query(" UNION ALL ".join(f"SELECT '{name}' AS strategy, * FROM ({exits_sql(target, stop)}){'' if way is None else f' WHERE side = {1 if way == 'up' else -1}'}" for name, _, way, target, stop in STRATEGIES[:3]))
def strategy_exits(spark, sf_dir):
    """Where each strategy of a list leaves its trades; the last one was deleted."""
    bars = B.orders_daily(spark, sf_dir)
    return T.run_strategies(bars, T.average_crosses(bars), T.without(STRATEGIES, 3)).drop("timeframe")


@query(f"WITH {CROSS} SELECT instrument, '1d' AS timeframe, ts, close AS price, side FROM crosses")
def stored_signals(spark, sf_dir):
    """Signals appended to a stored table and read back."""
    signals = store.Table(f"{work_dir(spark)}/signals-{uuid.uuid4().hex}", "instrument string, timeframe string, ts timestamp_ntz, price double, side int", (*KEY, "ts")).create(spark)
    found = T.average_crosses(B.orders_daily(spark, sf_dir)).withColumnRenamed("close", "price")
    signals.append(found.filter("side > 0"))
    signals.append(found.filter("side < 0"))
    return signals.rows(spark).drop("month")
