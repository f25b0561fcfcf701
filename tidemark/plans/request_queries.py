"""Signed requests, messages to readers, silent connections, names of sources, pages backwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import indicators as ind
from tidemark.operators import relational as R
from tidemark.operators import strategy as T
from tidemark.plans.indicator_queries import TIE
from tidemark.plans.registry import query
from tidemark.plans.series_queries import CROSS
from tidemark.runtime import table
from tidemark.sources import alerts, endpoints, signing
from tidemark.sources import bars as B
from tidemark.streaming import silence

KEY_ID, SECRET = "key-1", "not a secret"


def sql_hmac(text: str) -> str:
    """HMAC of a text expression in SQL, by its two padded hashes."""
    pad = lambda mask: "unhex('" + bytes(b ^ mask for b in SECRET.encode().ljust(signing.BLOCK, b"\0")).hex() + "')"
    return f"unhex(sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({text})))))"


SQL_TIME = "replace(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), ':', '%3A')"


@query(f"""WITH q AS (SELECT o_orderkey, 'AccessKeyId={KEY_ID}&SignatureMethod=HmacSHA256&SignatureVersion=2&Timestamp=' || {SQL_TIME} || '&note=a%20b%2A~%2F' || o_orderkey || '&symbol=' || o_orderstatus AS q FROM orders),
s AS (SELECT *, {sql_hmac("'GET' || chr(10) || 'api.example.org' || chr(10) || '/v1/orders' || chr(10) || q")} AS s FROM q)
SELECT o_orderkey, q || '&Signature=' || replace(replace(replace(to_base64(s), '+', '%2B'), '/', '%2F'), '=', '%3D') AS request, upper({sql_hmac("'GET' || chr(10) || 'api.example.org' || chr(10) || '/v1/orders' || chr(10) || 'id=' || o_orderkey")}::VARCHAR) AS older
FROM s""".replace("upper(unhex(", "upper((").replace("::VARCHAR", ""))
def signed_requests(spark, sf_dir):
    """Requests signed with the time of their order, in both forms."""
    url, orders = F.lit("https://api.example.org/v1/orders"), table(spark, sf_dir, "orders")
    params = F.create_map(F.lit("symbol"), F.col("o_orderstatus"), F.lit("note"), F.concat(F.lit("a b*~/"), F.col("o_orderkey").cast("string")), F.lit("gone"), F.lit(None).cast("string"))
    older = signing.hex_signature("GET", url, F.create_map(F.lit("id"), F.col("o_orderkey").cast("string")), SECRET)
    return orders.select("o_orderkey", signing.signed_query("GET", url, params, F.col("o_orderdate"), KEY_ID, SECRET).alias("request"), older.alias("older"))


def sql_filled(template: str, values: dict[str, str]) -> str:
    out = "'" + template + "'"
    for name, expr in values.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return out


def sql_price(x: str, commas: bool = True) -> str:
    """Two decimals; thousands apart by commas, for numbers below a thousand millions."""
    text = f"printf('%.2f', {x})"
    return f"regexp_replace({text}, '(\\d)(?:(\\d{{3}}))?(\\d{{3}})\\.', CASE WHEN abs({x}) >= 999999.995 THEN '\\1,\\2,\\3.' ELSE '\\1\\2,\\3.' END)" if commas else text


SIGNAL_SQL = {
    "mark": "CASE side WHEN 1 THEN '🟢' ELSE '🔴' END", "symbol": "instrument", "signal_type": "CASE side WHEN 1 THEN 'BUY' ELSE 'SELL' END", "timeframe": "'1d'", "strategy_name": "'Паттерн'", "pattern_type": "'N/A'",
    "entry_price": sql_price("close"), "target_price": sql_price("close * 1.5"), "stop_loss": "'0.00'", "expected_profit_percent": "'50.00'", "risk_reward_ratio": "'0.00'", "at": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
}


@query(f"WITH {CROSS} SELECT instrument, ts, {sql_filled(alerts.SIGNAL, SIGNAL_SQL)} AS message FROM crosses")
def signal_messages(spark, sf_dir):
    """A message for each cross of two averages."""
    side = F.when(F.col("side") == 1, "BUY").otherwise("SELL")
    text = alerts.signal_message(F.col("ts"), symbol=F.col("instrument"), signal_type=side, timeframe=F.col("timeframe"), entry_price=F.col("close"), target_price=F.col("close") * 1.5, expected_profit_percent=F.lit(50.0))
    return T.average_crosses(B.orders_daily(spark, sf_dir)).select("instrument", "ts", text.alias("message"))


@query("""SELECT event_type AS instrument, before AS ts, before + INTERVAL 3600 SECOND AS closed_at, before + INTERVAL 3603 SECOND AS reopened_at, ts AS heard_at
FROM (SELECT event_type, CAST(ts AS TIMESTAMP) AS ts, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM (SELECT DISTINCT event_type, ts FROM events)) WHERE ts > before + INTERVAL 3600 SECOND""")
def silences(spark, sf_dir):
    """Silences of each kind of event of more than an hour."""
    return silence.silences(table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), "ts"), limit=3600)


@query("""SELECT user_id AS instrument, CAST(max(ts) AS TIMESTAMP) AS ts, CASE WHEN (SELECT max(ts) FROM events) - max(ts) <= INTERVAL 60 SECOND THEN 'CONNECTED' WHEN (SELECT max(ts) FROM events) - max(ts) < INTERVAL 63 SECOND THEN 'WAIT_RECONNECT'
ELSE 'RECONNECTING' END AS state FROM events GROUP BY 1""")
def connection_states(spark, sf_dir):
    """The state of each user's connection at the time of the last message of all."""
    events = table(spark, sf_dir, "events")
    return silence.states(events.select(F.col("user_id").alias("instrument"), "ts"), events.agg(F.max("ts")))


@query("""SELECT n_nationkey, upper(n_name) AS symbol FROM nation WHERE lower(n_name) NOT IN (SELECT lower(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)""")
def new_names(spark, sf_dir):
    """Names that aren't known yet in any case of letters."""
    nation = table(spark, sf_dir, "nation")
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.initcap("n_name").alias("symbol"))
    return R.unknown_names(nation.select("n_nationkey", F.upper("n_name").alias("symbol")), known, "symbol")


@query("SELECT DISTINCT lower(n_name) AS symbol FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)")
def lower_names(spark, sf_dir):
    """The set of names without regard to case."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol")).unionAll(table(spark, sf_dir, "region").select(F.initcap("r_name")))
    return R.name_set(names, "symbol")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 100")
def page_backwards(spark, sf_dir):
    """The page of rows before an id, newest first."""
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 1000, "prev")


@query("""SELECT DISTINCT s.symbol, CASE s.symbol WHEN 'viewUSDT' THEN 'VIEW-USD' ELSE CASE WHEN suffix(s.symbol, 'USDT') THEN s.symbol[:-5] || '/USDT' ELSE s.symbol END END AS source
FROM (SELECT event_type || 'USDT' AS symbol FROM events UNION ALL SELECT event_type FROM events) s""")
def source_symbols(spark, sf_dir):
    """Names at a source: those of a map, others by their suffix."""
    kinds = table(spark, sf_dir, "events").select(F.explode(F.array(F.concat("event_type", F.lit("USDT")), F.col("event_type"))).alias("symbol")).distinct()
    return kinds.select("symbol", S.source_symbol(F.col("symbol"), {"viewUSDT": "VIEW-USD"}).alias("source"))


@query("""WITH t AS (SELECT event_type AS instrument, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2, 3)
SELECT instrument, ts, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w + 1e-9, 4) AS vwap FROM t WINDOW w AS (PARTITION BY instrument, day ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def vwap_by_day(spark, sf_dir):
    """The mean price by volume from the beginning of each day."""
    rows = ind.daily_vwap(B.events_hourly(spark, sf_dir))
    return rows.select("instrument", "ts", F.round(F.col("vwap") + TIE, 4).alias("vwap"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'https://api.example.org/market/history/kline?period=1day' || CASE WHEN o_custkey % 2 = 0 THEN '&size=' || o_custkey ELSE '' END || '&symbol=' || o_orderstatus || '%2F' || o_custkey END AS candles,
'https://api.example.org/v2/reference/currencies' || CASE WHEN o_orderstatus <> 'P' THEN '?currency=' || o_orderstatus ELSE '' END AS chains, 'https://api.example.org/market/tickers' AS tickers FROM orders""")
def request_urls(spark, sf_dir):
    """Addresses of requests for public data."""
    base, status, even = "https://api.example.org/", F.col("o_orderstatus"), F.col("o_custkey") % 2 == 0
    known = F.when(status != "P", status)
    symbol = F.concat(known, F.lit("/"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", endpoints.request_url("candles", base, symbol=symbol, period=F.lit("1day"), size=F.when(even, F.col("o_custkey"))).alias("candles"),
        endpoints.request_url("chains", base, currency=known).alias("chains"), endpoints.request_url("tickers", base).alias("tickers"),
    )


@query("""SELECT o_custkey, 's' || o_orderkey AS symbol, o_totalprice AS close, CAST(o_orderkey AS BIGINT) AS n_trades FROM orders WHERE o_custkey % 5 <> 0""")
def ticker_records(spark, sf_dir):
    """The tickers in an answer for each customer; every fifth answer is an error."""
    ticker = F.struct(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("symbol"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("count"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(ticker).alias("data"))
    status = F.when(F.col("o_custkey") % 5 != 0, "ok").otherwise("error")
    found = endpoints.records(lists.select("o_custkey", F.to_json(F.struct(status.alias("status"), "data")).alias("body")), "tickers")
    return found.select("o_custkey", "record.symbol", "record.close", F.col("record.count").alias("n_trades"))
