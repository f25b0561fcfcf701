"""Signatures against the standard library, messages, silences, pages."""

import base64
import datetime as dt
import hashlib
import hmac
from urllib import parse

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import source_symbol
from tidemark.operators import relational as R
from tidemark.sources import alerts, endpoints, signing
from tidemark.streaming import silence

T = dt.datetime(2024, 1, 31, 23, 59, 30)


@pytest.mark.parametrize("key", ["k", "é" * 32, "x" * 64, "y" * 200])
def test_hmac(spark, key):
    texts = ["", "a", "ünï\n" * 50, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(signing.hmac_sha256(key, F.col("t"))).collect()]
    assert [None if g is None else bytes(g) for g in got] == [None if t is None else hmac.new(key.encode(), t.encode(), hashlib.sha256).digest() for t in texts]


@pytest.mark.parametrize("version", ["2", "2.1"])
def test_signed_query(spark, version):
    given = {"Z": "a b+c", "a": "*~/é%", "none": None}
    rows = spark.createDataFrame([(given, "https://h.example.org:8443/v1/x", T)], "p map<string, string>, url string, at timestamp_ntz")
    got = rows.select(signing.signed_query("POST", F.col("url"), F.col("p"), F.col("at"), "id", "secret", version)).first()[0]
    names = signing.ADDED[version]
    params = {"Z": "a b+c", "a": "*~/é%", names[0]: "id", names[1]: version, names[2]: "HmacSHA256", names[3]: "2024-01-31T23:59:30"}
    query = "&".join(f"{k}={parse.quote(params[k], safe='')}" for k in sorted(params))
    sign = base64.b64encode(hmac.new(b"secret", f"POST\nh.example.org\n/v1/x\n{query}".encode(), hashlib.sha256).digest()).decode()
    assert got == f"{query}&{names[4]}={parse.quote(sign, safe='')}"
    with pytest.raises(ValueError):
        signing.signed_query("GET", F.col("url"), F.col("p"), F.col("at"), "id", "")


def test_messages(spark):
    one = spark.range(1)
    text = one.select(alerts.signal_message(F.lit(T), symbol=F.lit("{at}"), signal_type=F.lit("SELL"), entry_price=F.lit(1234567.125), risk_reward_ratio=F.lit(1234.5))).first()[0]
    assert text.startswith(f"{alerts.OTHER_MARK} <b>") and "</b> {at}\n" in text and "$1,234,567.12\n" in text and "1:1234.50" in text and "2024-01-31 23:59:30" in text and "</b> N/A" in text
    text = one.select(alerts.backtest_message(F.lit(T), strategy_name=F.lit("s"), total_trades=F.lit(7), win_rate=F.lit(42.857))).first()[0]
    assert "</b> s\n" in text and ": 7\n" in text and "42.86%" in text and "0.00%" in text and "{" not in text


def test_delivery(spark, tmp_path):
    folder = str(tmp_path)

    def send(rows):
        for r in rows:
            with open(f"{folder}/{r.id}", "w") as f:
                f.write(r.message)

    alerts.deliver(spark.range(20).select("id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("message")).repartition(4), send)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {str(i): f"m{i}" for i in range(20)}


@pytest.mark.parametrize("span", [1, 2048])
def test_silences(spark, span):
    at = lambda s: T + dt.timedelta(seconds=s)
    rows = [("a", at(s)) for s in (0, 60, 60, 121, 1000)] + [("b", at(5))]
    df = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz")
    got = sorted(tuple(r) for r in silence.silences(df, span=span).collect())
    assert got == [("a", at(60), at(120), at(123), at(121)), ("a", at(121), at(181), at(184), at(1000))]
    for now, want in ((1060, "CONNECTED"), (1061, "WAIT_RECONNECT"), (1063, "RECONNECTING")):
        assert {r.instrument: r.state for r in silence.states(df, spark.createDataFrame([(at(now),)], "now timestamp_ntz")).collect()} == {"a": want, "b": "RECONNECTING"}
    assert silence.silences(df.limit(0)).isEmpty()


def test_names_and_pages(spark):
    names = spark.createDataFrame([("Btc",), ("ETH",), (None,)], "symbol string")
    known = spark.createDataFrame([("BTC",), (None,)], "symbol string")
    assert {r.symbol for r in R.unknown_names(names, known, "symbol").collect()} == {"ETH", None}
    assert {r.symbol for r in R.name_set(names.union(known), "symbol").collect()} == {"btc", "eth"}
    rows = spark.range(10)
    ids = lambda *a: [r.id for r in R.page(rows, "id", 3, *a).collect()]
    assert (ids(), ids(7), ids(2, "prev"), ids(None, "prev")) == ([0, 1, 2], [8, 9], [1, 0], [9, 8, 7])
    with pytest.raises(ValueError):
        R.page(rows, "id", 3, 1, "down")
    got = [r[0] for r in spark.createDataFrame([("BTCUSDT",), ("XUSDT",), ("USDT",), ("abc",), (None,)], "s string").coalesce(1).select(source_symbol(F.col("s"), {"XUSDT": "X-USD"})).collect()]
    assert got == ["BTC/USDT", "X-USD", "/USDT", "abc", None]


def test_endpoints(spark):
    one = spark.range(1)
    url = lambda name, **p: one.select(endpoints.request_url(name, "https://x", **p)).first()[0]
    assert url("depth", symbol=F.lit("a b"), type=F.lit("step0"), depth=F.lit(None)) == "https://x/market/depth?symbol=a%20b&type=step0"
    assert url("detail", symbol=F.lit(None)) is None and url("timestamp") == "https://x/v1/common/timestamp"
    for bad in ({}, {"symbol": F.lit("a"), "size": F.lit(1)}):
        with pytest.raises(ValueError):
            endpoints.request_url("detail", "https://x", **bad)

    def read(name, *bodies):
        rows = spark.createDataFrame(list(enumerate(bodies)), "k int, body string").coalesce(1)
        return [(r.k, r.record) for r in endpoints.records(rows, name).collect()]

    got = read("merged", '{"status": "ok", "tick": {"id": 7, "bid": [1.5, 2], "close": 3}}', '{"status": "error", "tick": {"id": 8}}', "no json", None, '{"status": "ok"}')
    assert [(k, r["id"], r["bid"], r["close"]) for k, r in got] == [(0, 7, [1.5, 2.0], 3.0)]
    assert read("currencies", '{"status": "ok", "data": ["a", "b"]}', '{"status": "ok", "data": []}') == [(0, "a"), (0, "b")]
    assert read("timestamp", '{"status": "ok", "data": 1700000000000}') == [(0, 1700000000000)]
    got = read("symbols", '{"status": "ok", "data": [{"base-currency": "b", "price-precision": 2, "symbol": "bq"}]}')
    assert [(r["base-currency"], r["price-precision"], r["symbol"], r["state"]) for _, r in got] == [("b", 2, "bq", None)]
    assert [r["marketStatus"] for _, r in read("market_status", '{"code": 200, "data": {"marketStatus": 1}}', '{"code": 500, "data": {"marketStatus": 2}}')] == [1]
    got = read("trades", '{"status": "ok", "data": [{"id": 1, "ts": 2, "data": [{"price": 3.5, "direction": "buy"}]}]}')
    assert [(r["id"], r["data"][0]["price"], r["data"][0]["direction"]) for _, r in got] == [(1, 3.5, "buy")]
