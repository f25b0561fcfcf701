"""Edge cases of services' answers, new keys and rules by code."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import relational as R
from tidemark.plans import catalog
from tidemark.sources import connectors as C


def test_array_bars(spark):
    rows = [("a", '[[86400000, 1, 2, 0.5, 1.5, "7"], [null, 1, 1, 1, 1, 1], ["x"]]'), ("a", '[[86400000, 1, 2, 0.5, 1.5, "7"], [172800000, "?", 2]]'), ("b", "no json"), ("c", None), ("d", "[]")]
    got = sorted(C.array_bars(spark.createDataFrame(rows, "instrument string, body string")).collect())
    assert [tuple(r)[2:] for r in got] == [(1.0, 2.0, 0.5, 1.5, 7.0, 0), (None, 2.0, None, None, None, 0)]
    assert [str(r.ts) for r in got] == ["1970-01-02 00:00:00", "1970-01-03 00:00:00"]


def test_records(spark):
    rows = [("a", {"timestamp": "2024-01-01 00:00:00", "open": "1", "Volume": "0.125"}), ("b", {"id": "86400"}), ("c", None)]
    got = {r.instrument: r for r in C.record_bars(spark.createDataFrame(rows, "instrument string, fields map<string,string>")).collect()}
    assert (got["a"].open, got["a"].volume, got["b"].close, got["c"].ts) == (1.0, 0.12, 0.0, None)
    assert got["b"].ts == datetime.datetime(1970, 1, 2)


def test_judged(spark):
    bodies = [None, "", "text", '{"status": "", "success": true}', '{"code": "200", "success": false}', '{"success": false}', '{"status": "error"}']
    got = {r.k: (r.accepted, r.fault) for r in C.judged(spark.createDataFrame(list(enumerate(bodies)), "k int, body string")).collect()}
    assert got == {0: (False, "no status"), 1: (False, "no status"), 2: (False, "no status"), 3: (True, None), 4: (True, None), 5: (False, ""), 6: (False, "0: ")}


def test_new_ids(spark):
    stored = spark.createDataFrame([(4, "BTC"), (9, "eth")], "id int, name string")
    names = spark.createDataFrame([("btc",), ("sol",), ("SOL",), ("ada",), (None,), ("",), ("addx",)], "name string")
    assert sorted(map(tuple, R.with_new_ids(names, stored, "name", "id").collect())) == [(4, "BTC"), (9, "eth"), (10, ""), (11, "ada"), (12, "addx"), (13, "SOL")]
    assert sorted(map(tuple, R.with_new_ids(names, stored.limit(0), "name", "id").collect()))[0] == (1, "")
    assert R.with_new_ids(names.limit(0), stored, "name", "id").count() == 2


def test_newer_than_mark(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), (None, 1)], "k string, t int")
    stored = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, t int")
    assert sorted(((r.k or "", r.t) for r in R.newer_than_mark(rows, stored, "k", "t").collect())) == [("", 1), ("a", 3), ("b", 1)]


def test_rules(spark):
    row = spark.range(1).select(S.history_years(F.lit("5m")), S.history_years(F.lit("?")), S.refresh_seconds(F.lit("?")), S.beijing_to_utc_millis(F.lit(5)), S.filled("{a} {b}", a=F.lit("$1"), b=F.lit(None)), C.fund_error(F.lit(1)))
    assert tuple(row.first()) == (0.5, 2.0, 60, 0, "$1 N/A", "")


def test_messages_of_all_orders(spark):
    """Every order has its row, those up to the year 2000 with 0."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rows = catalog.QUERIES["messages"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == orders.count() == 1500
    zero = [r for r in rows if r.from_seconds == 0]
    assert len(zero) == 1161 and all(r.from_millis == 0 and r.message.endswith(f"#{r.o_orderkey}") for r in zero)
    first = 946_656_000
    shifted = spark.createDataFrame([(first, first * 1000), (first + 1, first * 1000 + 1), (first * 1000, 788_918_400_000)], "s long, ms long")
    got = shifted.select(S.beijing_seconds_to_utc_millis(F.col("s")), S.beijing_millis_to_utc_millis(F.col("ms"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), ((first + 1 - 28800) * 1000, first * 1000 + 1 - 28_800_000), (0, 0)]


def test_symbols_with_total_volume(spark):
    """Every customer counts; symbols without a ticker or without volume go."""
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").toPandas()
    want = customers.assign(vol=customers.c_acctbal.round().clip(lower=0)).groupby("c_nationkey").vol.sum()
    got = {r.n_nationkey: r.vol for r in catalog.QUERIES["symbols_with_volume"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: v for k, v in want.items() if v}
    symbols = spark.createDataFrame([("BTC",), ("ETH",), ("ADA",), ("SOL",), ("XRP",)], "symbol string")
    tickers = spark.createDataFrame([("btc", 2.0), ("Eth", 0.0), ("ada", None), ("xrp", -1.0), ("dot", 3.0)], "symbol string, vol double")
    assert sorted(map(tuple, C.with_volume(symbols, tickers).select("symbol", "vol").collect())) == [("BTC", 2.0), ("XRP", -1.0)]
