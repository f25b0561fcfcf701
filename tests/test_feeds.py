"""Edge cases of captured messages and of rows paired without a key."""

import gzip

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alignment as A
from tidemark.sources import feeds


def test_pages(spark):
    bar = '{"id": 86400, "open": 1, "high": 3, "low": 1, "close": %d, "vol": 5}'
    ok = '{"status": "ok", "data": [%s]}'
    rows = [("a", 1, ok % (bar % 2)), ("a", 2, ok % (bar % 3)), ("a", 3, '{"status": "error", "data": []}'), ("b", 1, "no json"), ("c", 1, None), ("d", 1, ok % "")]
    got = feeds.page_bars(spark.createDataFrame(rows, "instrument string, page int, body string")).collect()
    assert [(r.instrument, str(r.ts), r.close, r.volume) for r in got] == [("a", "1970-01-02 00:00:00", 3.0, 5.0)]


def test_frames(spark):
    rows = [(1, gzip.compress(b'{"k": 1}')), (2, b"not gzip"), (3, None), (4, gzip.compress(b"")), (5, gzip.compress(b"cut short")[:-9])]
    out = feeds.unpacked(spark.createDataFrame(rows, "id int, frame binary"), "frame", "text")
    assert {r.id: r.text for r in out.collect()} == {1: '{"k": 1}', 2: None, 3: None, 4: "", 5: None}
    assert feeds.unpacked(out.drop("text").limit(0), "frame", "text").count() == 0


def test_requests_and_channels(spark):
    df = spark.range(1)
    given, defaults = F.create_map(F.lit("b"), F.lit("1 2"), F.lit("a"), F.lit("")), F.create_map(F.lit("a"), F.lit("x"), F.lit("c"), F.lit("é"), F.lit("d"), F.lit(""))
    assert df.select(feeds.request_string(feeds.with_defaults(given, defaults))).first()[0] == "a=&b=1+2&c=%C3%A9"
    name = feeds.channel(F.lit("btcusdt"), F.lit("depth"), F.lit("step0"))
    assert tuple(df.select(name, feeds.channel_symbol(name)).first()) == ("market.btcusdt.depth.step0", "btcusdt")


def test_first_nonempty(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    got = A.first_nonempty([rows(("a", 1)), rows(("a", 2), ("b", 3), (None, 4)), rows(("b", 5), ("c", 6), ("c", 6))], "k")
    assert sorted((str(r.k), r.v) for r in got.collect()) == [("None", 4), ("a", 1), ("b", 3), ("c", 6), ("c", 6)]


def test_gaps_and_labels(spark):
    bars = spark.sql("select k, cast(t as timestamp_ntz) as ts from values ('a', '2024-01-01 00:00:00'), ('a', '2024-01-01 00:00:10'), ('a', '2024-01-01 00:01:00'), ('b', '2024-01-01') as v(k, t)")
    assert {r.k: r.mean_gap for r in A.mean_gap(bars, "k", "ts").collect()} == {"a": 30.0, "b": None}
    labels = bars.filter("k = 'b'").select(*[S.axis_label(F.lit(c), F.col("ts")) for c in ("1d", "1w", "4h", "15m", "?")])
    assert tuple(labels.first()) == ("01 Jan", "01.01", "01.01 00:00", "00:00", "00:00")
