"""Messages of an exchange: routing, records by kind, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import filled, to_display

ENVELOPE = "status string, `err-code` string, `err-msg` string, op string, action string, ch string, rep string, ping bigint, ts bigint, code int, data string"
#: What a channel's or an answer's records hold, by the kind of channel: a registry that callers extend.
RECORDS = {
    "kline": "id bigint, open double, close double, low double, high double, amount double, vol double, count bigint",
    "depth": "bids array<array<double>>, asks array<array<double>>, ts bigint, version bigint",
    "bbo": "symbol string, quoteTime bigint, bid double, bidSize double, ask double, askSize double",
    "trade": "id bigint, ts bigint, data array<struct<tradeId: bigint, price: double, amount: double, direction: string, ts: bigint>>",
    "detail": "id bigint, open double, close double, low double, high double, amount double, vol double, count bigint",
}


def routed(messages: DataFrame, body: str = "body") -> DataFrame:
    """messages with kind and reason. In this order: a status other than ok, or an error code other than 0,
    is an error; then op (notify and req are data, ping, auth), action (push with data, ping, sub and req,
    which are acknowledged by code 200), a channel, an answer and a ping decide; others, and what isn't
    JSON, are unknown."""
    x = F.from_json(body, ENVELOPE)
    given = lambda c: F.coalesce(x[c], F.lit("")) != ""
    acknowledged = F.when(x["code"] == 200, "ack").otherwise("error")
    kind = (
        F.when((given("status") & (x["status"] != "ok")) | (given("err-code") & (x["err-code"] != "0")), "error")
        .when(given("op"), F.when(x["op"].isin("notify", "req"), "data").when(x["op"] == "ping", "ping_trade").when(x["op"] == "auth", "auth").otherwise("unknown"))
        .when(given("action"), F.when(x["action"] == "ping", "ping_account").when(x["action"].isin("sub", "req"), acknowledged).when(x["action"] == "push", F.when(given("data"), "data").otherwise("error")).otherwise("unknown"))
        .when(given("ch"), "data").when(given("rep"), "answer").when(F.coalesce(x["ping"], F.lit(0)) != 0, "ping_market").otherwise("unknown")
    )
    reason = F.concat_ws(": ", F.coalesce(x["err-code"], F.lit("Unknown error")), F.coalesce(x["err-msg"], F.lit("Unknown error")))
    out = messages.withColumn("kind", kind)
    return out.withColumn("reason", F.when(F.col("kind") == "error", reason)).withColumn("channel", F.coalesce(x["ch"], x["rep"]))


def parsed(messages: DataFrame, kind: str, body: Column | str = "body", records: dict[str, str] = RECORDS) -> DataFrame:
    """messages with the column record, read from their `tick` or else `data` by the schema of a kind;
    null where it can't be read. Keys with - are named with _."""
    keyed = F.regexp_replace(body, r'"([A-Za-z]+)-([A-Za-z]+)"(\s*:)', '"$1_$2"$3')
    text = F.coalesce(F.get_json_object(keyed, "$.tick"), F.get_json_object(keyed, "$.data"))
    return messages.withColumn("record", F.from_json(text, records[kind]))


def account_of(accounts: DataFrame, kind: str, symbol: str | None = None) -> DataFrame:
    """The first account (id, type, subtype, ...) of a type; only a margin account's subtype must be the
    symbol."""
    fits = (F.col("type") == kind) & ((F.col("type") != "margin") | F.col("subtype").eqNullSafe(F.lit(symbol)))
    return accounts.filter(fits).orderBy("id").limit(1)


def sufficient(accounts: DataFrame, least: float = 0.0) -> DataFrame:
    """Accounts with their entries over a balance; those without any keep an empty list."""
    return accounts.withColumn("entries", F.filter("entries", lambda e: e["balance"] > least))


def latest_prices(symbols: DataFrame, tickers: DataFrame) -> DataFrame:
    """symbol and close of every symbol, null where there is no ticker: the newest one's close."""
    last = tickers.groupBy(F.lower("symbol").alias("_name")).agg(F.max_by("close", "ts").alias("close"))
    return symbols.join(last, F.lower("symbol") == F.col("_name"), "left").select("symbol", "close")


# Channels by name, subscribed to or asked for once; account channels; topics of requests.
MARKET_CHANNELS = {
    "kline": "market.{symbol}.kline.{interval}", "trade": "market.{symbol}.trade.detail", "depth": "market.{symbol}.depth.{step}", "bbo": "market.{symbol}.bbo", "detail": "market.{symbol}.detail",
    "ticker": "market.{symbol}.ticker", "mbp": "market.{symbol}.mbp.{levels}", "mbp_full": "market.{symbol}.mbp.refresh.{levels}",
}
ACCOUNT_CHANNELS = {"orders": "orders#{symbol}", "accounts": "accounts.update#{mode}", "clearing": "trade.clearing#{symbol}#{mode}"}
TOPICS = {"accounts": "accounts.list", "orders": "orders.list", "order": "orders.detail"}


def market_message(name: str, message_id: Column, once: bool = False, since: Column | None = None, until: Column | None = None, **parts: Column) -> Column:
    """The JSON that subscribes to a market channel, or asks for it once, from and to a time in seconds."""
    given = [(since, "from"), (until, "to")] if once else []
    fields = [filled(MARKET_CHANNELS[name], **parts).alias("req" if once else "sub"), message_id.cast("string").alias("id"), *[c.cast("long").alias(n) for c, n in given if c is not None]]
    return F.to_json(F.struct(*fields))


def account_message(name: str, **parts: Column) -> Column:
    """The JSON that subscribes to an account channel."""
    return F.to_json(F.struct(F.lit("sub").alias("action"), filled(ACCOUNT_CHANNELS[name], **parts).alias("ch")))


def topic_message(name: str, message_id: Column, **fields: Column) -> Column:
    """The JSON of a request for a topic; fields that are null are left out, _ in a name stands for -."""
    named = [c.alias(n.replace("_", "-")) for n, c in fields.items()]
    return F.to_json(F.struct(F.lit("req").alias("op"), F.lit(TOPICS[name]).alias("topic"), message_id.cast("string").alias("cid"), *named))


def tick_row(messages: DataFrame, body: str = "body") -> DataFrame:
    """symbol, local_ts (display zone), low, high, open, close, volume, amount of snapshots with a tick."""
    x = F.from_json(body, "ts bigint, tick struct<low: double, high: double, open: double, close: double, vol: double, amount: double>")
    rows = messages.withColumn("_x", x).filter("_x.tick is not null")
    local = to_display(F.timestamp_millis("_x.ts").cast("timestamp_ntz")).alias("local_ts")
    return rows.select("symbol", local, *[F.col(f"_x.tick.{c}").alias(c) for c in ("low", "high", "open", "close")], F.col("_x.tick.vol").alias("volume"), F.col("_x.tick.amount").alias("amount"))


# Characters that a symbol or currency must not have.
FORBIDDEN = r"[ _`~!@#$%^&*()+=|{}':;,\[\].<>/?～！￥…（）—【】‘；：”“’。，、？\n\t]"
MARKET_ORDERS, NOT_FOR_MARKET = ("buy-market", "sell-market"), ("gtc", "boc", "fok")


def valid_name(c: Column) -> Column:
    """Of a symbol or a currency."""
    return c.isNotNull() & ~F.regexp_like(c, F.lit(FORBIDDEN))


def valid_names(c: Column) -> Column:
    return c.isNotNull() & F.forall(c, valid_name)


def in_range(c: Column, low, high) -> Column:
    return c.isNull() | c.between(low, high)


def in_list(c: Column, *values) -> Column:
    return c.isNull() | c.isin(*values)


def of_length(c: Column, least: int, most: int) -> Column:
    return c.isNull() | F.size(c).between(least, most)


def at_least(c: Column, base) -> Column:
    return c.isNull() | (c >= base)


def valid_time_in_force(time_in_force: Column, order_type: Column) -> Column:
    return time_in_force.isNull() | ~(order_type.isin(*MARKET_ORDERS) & time_in_force.isin(*NOT_FOR_MARKET))


def formatted_date(c: Column) -> Column:
    """A date as yyyy-MM-dd with all its zeros; null for what isn't one."""
    return F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.date_format(c.try_cast("date"), "yyyy-MM-dd"))
