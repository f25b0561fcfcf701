"""Stored tables, update passes, streams that go on, routing and accounts on small hand-made rows."""

import datetime as dt
import time
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alignment as A
from tidemark.operators import relational as R
from tidemark.operators import strategy as T
from tidemark.operators import updates as U
from tidemark.sources import connectors as C
from tidemark.sources import folder, store
from tidemark.sources import messages as M
from tidemark.streaming import ingest

BARS = "instrument string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, *rows):
    return spark.createDataFrame([(i, f, t, c, c, c, c, 1.0) for i, f, t, c in rows], BARS)


def day(k, month=1):
    return dt.datetime(2024, month, 1) + dt.timedelta(days=k)


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    table = store.bars(f"{tmp_path}/bars").create(spark)
    assert table.rows(spark).isEmpty()
    table.upsert(bars(spark, ("x", "1d", day(0), 1.0), ("x", "1d", day(0, 2), 2.0), ("x", "1w", day(0), 5.0)))
    other = sorted(str(p) for p in Path(f"{tmp_path}/bars/timeframe=1d/month=2024-02").glob("*.parquet"))
    for _ in range(2):
        table.upsert(bars(spark, ("x", "1d", day(0), 9.0), ("x", "1d", day(1), 3.0), ("x", "1d", day(1), 4.0)).withColumn("n", F.col("close")), F.col("n"))
    assert {(r.timeframe, r.ts, r.close) for r in table.rows(spark).collect()} == {("1d", day(0), 9.0), ("1d", day(1), 4.0), ("1d", day(0, 2), 2.0), ("1w", day(0), 5.0)}
    assert sorted(str(p) for p in Path(f"{tmp_path}/bars/timeframe=1d/month=2024-02").glob("*.parquet")) == other
    assert [r.close for r in table.read(spark, instrument="x", timeframe="1d").collect()] == [9.0, 4.0, 2.0]
    assert {(r.timeframe, r.last_ts) for r in table.latest(spark).collect()} == {("1d", day(0, 2)), ("1w", day(0))}
    assert store.bars(f"{tmp_path}/bars").create(spark).rows(spark).count() == 4


def test_updates(spark):
    offered = bars(spark, *[("x", "1d", day(k), float(k)) for k in range(200)], *[("x", "5m", day(k), float(k)) for k in range(200)], *[("new", "1d", day(k), float(k)) for k in range(200)], ("x", "1d", day(199), 199.0))
    stored = bars(spark, ("x", "1d", day(150), 0.0), ("x", "5m", day(100), 0.0))
    now = spark.createDataFrame([(day(200),)], "now timestamp_ntz")
    got = {(r.instrument, r.timeframe): (r.n, r.first) for r in U.missing_bars(offered, stored, now).groupBy("instrument", "timeframe").agg(F.count("ts").alias("n"), F.min("ts").alias("first")).collect()}
    assert got == {("x", "1d"): (49, day(151)), ("x", "5m"): (6, day(194)), ("new", "1d"): (100, day(100))}
    assert U.missing_bars(offered, offered, now).isEmpty()
    assert U.missing_bars(offered.limit(0), stored, now).isEmpty()


def test_due_by_refresh_interval(spark):
    now = dt.datetime(2024, 1, 2)
    rows = [(f, tf, now - dt.timedelta(seconds=s)) for f, tf, s in (("a", "1w", 86400), ("b", "1w", 86399), ("c", "3m", 60), ("d", "12h", 14399), ("e", "?", 60))] + [("f", "1d", None)]
    got = A.due(spark.createDataFrame(rows, "instrument string, timeframe string, last_ts timestamp_ntz"), spark.createDataFrame([(now,)], "now timestamp_ntz"))
    assert {r.instrument for r in got.collect()} == {"a", "c", "e", "f"}


def test_as_of_over_buckets_and_ties(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda h: t + dt.timedelta(hours=h)
    left = spark.createDataFrame([("a", at(h), h) for h in (0, 5, 30, 100, 101)] + [(None, at(3), 3), ("b", at(1), 1)], "k string, t timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(5), 1.0), ("a", at(5), 2.0), ("a", at(29), None), ("a", at(100.5), 7.0), (None, at(2), 4.0)], "k string, t timestamp_ntz, v double")
    got = {(r.k, r.id): r.v for r in R.as_of(left, right, ["k"], "t", "v").collect()}
    assert got == {("a", 0): None, ("a", 5): 2.0, ("a", 30): 2.0, ("a", 100): 2.0, ("a", 101): 7.0, (None, 3): 4.0, ("b", 1): None}


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    schema = "instrument string, ts timestamp_ntz, seq long, price double, volume double"
    table = store.bars(f"{tmp_path}/bars")
    for k, prices in enumerate(([1.0, 2.0], [5.0])):
        spark.createDataFrame([("x", dt.datetime(2024, 1, 1, 0, 10 * k + i), k * 10 + i, p, 1.0) for i, p in enumerate(prices)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            stream = ingest.landing(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
            ingest.run_stored(ingest.tick_bars(stream), table, f"{tmp_path}/check")
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in table.rows(spark).collect()] == [(1.0, 5.0, 1.0, 5.0, 3.0)]


def test_failures_are_told(spark, tmp_path):
    told = []
    listener = ingest.Failures(told.append)
    spark.streams.addListener(listener)
    try:
        spark.range(3).write.parquet(f"{tmp_path}/in")
        stream = ingest.landing(spark, f"{tmp_path}/in", spark.range(0).schema)
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda batch, number: 1 / 0).start()
        for _ in range(100):
            if told:
                break
            time.sleep(0.2)
        assert not query.isActive and "ZeroDivisionError" in told[0] and listener.found[0][0] == query.id
    finally:
        spark.streams.removeListener(listener)


def test_background_updates_stop(spark, tmp_path):
    schema = "instrument string, ts timestamp_ntz, seq long, price double, volume double"
    spark.createDataFrame([("x", day(0), 1, 1.0, 1.0)], schema).write.parquet(f"{tmp_path}/in")
    table = store.bars(f"{tmp_path}/bars")
    query = ingest.start_updates(ingest.tick_bars(ingest.landing(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)), table, f"{tmp_path}/check", "1 second")
    query.processAllAvailable()
    query.stop()
    assert not query.isActive and table.rows(spark).count() == 1


def test_router_and_records(spark):
    rows = [("status wins", '{"status": "x", "op": "ping"}', "error"), ("code 0", '{"err-code": 0, "action": "ping"}', "ping_account"), ("op wins", '{"op": "notify", "action": "ping", "ch": "c"}', "data"), ("other op", '{"op": "sub", "ch": "c"}', "unknown"),
            ("empty", '{"status": "ok", "op": "", "action": "", "ch": "", "rep": "r"}', "answer"), ("null", None, "unknown"), ("none", '{"ping": 0}', "unknown")]
    got = M.routed(spark.createDataFrame(rows, "name string, body string, want string")).collect()
    assert all(r.kind == r.want for r in got), got
    body = spark.createDataFrame([('{"tick": {"bids": [[1, 2]], "asks": [], "ts": 5, "version": 7}}',), ('{"tick": 3}',), (None,)], "body string")
    assert [None if r.record is None else r.record.version for r in M.parsed(body, "depth").collect()] == [7, None, None]


def test_accounts_and_prices(spark):
    accounts = spark.createDataFrame([(2, "spot", "z", [("a", 0.0), ("b", 0.2)]), (1, "margin", "btc", []), (3, "margin", "eth", [])], "id long, type string, subtype string, entries array<struct<currency: string, balance: double>>")
    assert M.account_of(accounts, "spot", "other").first().id == 2 and M.account_of(accounts, "margin", "eth").first().id == 3
    assert M.account_of(accounts, "margin").isEmpty() and M.account_of(accounts, "point").isEmpty()
    assert [e.currency for e in M.sufficient(accounts).first().entries] == ["b"]
    tickers = spark.createDataFrame([("btc", 1, 5.0), ("BTC", 2, 6.0)], "symbol string, ts long, close double")
    assert {r.symbol: r.close for r in M.latest_prices(spark.createDataFrame([("Btc",), ("eth",)], "symbol string"), tickers).collect()} == {"Btc": 6.0, "eth": None}


def test_caps_and_rules(spark):
    coins = spark.createDataFrame([(k, float(k)) for k in range(300)], "id long, cap double")
    none = spark.createDataFrame([], "top double")
    assert R.within_ratio(coins, "cap", none, 4e9).count() == 100
    assert R.largest_within_ratio(coins, "cap", "id", spark.createDataFrame([(500.0,)], "top double"), limit=400).count() == 51
    assert R.missing_columns(coins, ["id", "open"]) == ["open"]
    assert [C.recent_days(c, n) for c, n in (("5m", 9), ("1h", 24), ("1h", 500), ("1d", 10), ("1d", 5000))] == [7, 7, 21, 30, 730]
    assert T.without([1, 2], 5) == [1, 2] and T.without([1, 2], 0) == [2] and T.without([1], -1) == [1]
    assert tuple(spark.range(1).select(S.filled("{a} {b} {c}", a=F.lit("{b}"), b=F.lit(2))).first()) == ("{b} 2 {c}",)


def test_tables_of_a_folder(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/b.parquet")
    spark.range(7).write.parquet(f"{tmp_path}/a.parquet")
    (tmp_path / "notes.txt").write_text("x")
    assert [tuple(r) for r in folder.table_counts(spark, str(tmp_path)).orderBy("name").collect()] == [("a", 7), ("b", 3)]
    assert [r.id for r in folder.sample(spark.read.parquet(f"{tmp_path}/a.parquet"), "id").collect()] == [0, 1, 2, 3, 4]
