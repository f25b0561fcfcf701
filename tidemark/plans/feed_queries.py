"""Captured messages, preferred sources, positions, labels and shapes over the driver tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alignment as A
from tidemark.plans.registry import query
from tidemark.runtime import table
from tidemark.sources import feeds


@query("""WITH o AS (SELECT o_orderstatus AS instrument, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, max(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT instrument, ts, x + 1 AS open, x + 1 AS high, x + 1 AS low, x + 1 AS close, CAST(n AS DOUBLE) AS volume FROM o""")
def page_bars(spark, sf_dir):
    """Pages by year, each bar on two of them: the later page's is the one that counts."""
    day = F.date_trunc("day", F.col("o_orderdate"))
    bars = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("instrument"), day.alias("ts")).agg(F.max("o_totalprice").alias("x"), F.count(F.lit(1)).alias("n"))
    bars = bars.withColumn("page", F.explode(F.array(F.year("ts"), F.year("ts") + 100))).withColumn("x", F.col("x") + F.when(F.col("page") > F.year("ts"), 1).otherwise(0))
    bar = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("id"), *[F.col("x").alias(c) for c in ("open", "high", "low", "close")], F.col("n").cast("double").alias("vol"))
    pages = bars.groupBy("instrument", "page").agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.collect_list(bar).alias("data"))).alias("body"))
    return feeds.page_bars(pages)


@query("SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, l_extendedprice AS price, l_quantity AS amount FROM lineitem")
def depth_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", feeds.levels(F.array(F.array("l_extendedprice", "l_quantity"))).alias("bids"))
    return rows.select("l_orderkey", "l_linenumber", F.explode("bids").alias("b")).select("l_orderkey", "l_linenumber", "b.price", "b.amount")


def gzip_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: gzip.compress(x.encode(), 1), na_action="ignore")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def gzip_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("event_id", F.pandas_udf(gzip_all, "binary")("props").alias("frame"))
    return feeds.unpacked(frames, "frame", "body").select("event_id", F.from_json("body", "k long")["k"].alias("k"))


@query("SELECT DISTINCT 'market.' || event_type || '.kline.' || CASE WHEN user_id % 2 = 0 THEN '1min' ELSE '1day' END AS channel, event_type AS symbol FROM events")
def channels(spark, sf_dir):
    period = F.when(F.col("user_id") % 2 == 0, "1min").otherwise("1day")
    names = table(spark, sf_dir, "events").select(feeds.channel(F.col("event_type"), F.lit("kline"), period).alias("channel")).distinct()
    return names.select("channel", feeds.channel_symbol(F.col("channel")).alias("symbol"))


@query("SELECT o_orderkey, 'clerk=x%2Fy&date=' || replace(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), ':', '%3A') || '&status=' || o_orderstatus AS request FROM orders")
def request_strings(spark, sf_dir):
    given = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("date"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    defaults = F.create_map(F.lit("status"), F.lit("none"), F.lit("clerk"), F.lit("x/y"), F.lit("limit"), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", feeds.request_string(feeds.with_defaults(given, defaults)).alias("request"))


@query("""SELECT o_custkey, o_orderkey, CAST(source_number AS INTEGER) AS source_number FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS source_number FROM orders WHERE o_orderstatus IN ('P', 'F', 'O'))
QUALIFY source_number = min(source_number) OVER (PARTITION BY o_custkey)""")
def first_source(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return A.first_nonempty([orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "PFO"], "o_custkey")


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), e AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
SELECT k, CAST(place AS INTEGER) AS place, o_orderkey, event_id FROM o JOIN e USING (k, place)""")
def positional_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return A.by_position(orders, table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id"), "k", "o_orderkey", "event_id")


@query("SELECT event_type, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / nullif(count(ts) - 1, 0), 4) AS mean_gap FROM events GROUP BY 1")
def mean_gap(spark, sf_dir):
    return A.mean_gap(table(spark, sf_dir, "events"), "event_type", "ts").select("event_type", F.round("mean_gap", 4).alias("mean_gap"))


#: Each kind of event stands for a timeframe here.
KIND_FRAMES = {"click": "5m", "view": "15m", "signup": "1h", "error": "4h", "purchase": "1d"}
FRAME_SECONDS = ", ".join(f"('{kind}', '{code}', {S.REFRESH_SECONDS[code]})" for kind, code in KIND_FRAMES.items())


@query(f"""WITH last AS (SELECT user_id AS instrument, timeframe, seconds, max(ts) AS last_ts FROM events JOIN (VALUES {FRAME_SECONDS}) AS t(kind, timeframe, seconds) ON kind = event_type GROUP BY 1, 2, 3),
now AS (SELECT max(ts) AS now FROM events) SELECT instrument, timeframe FROM last, now WHERE floor(epoch(now)) - floor(epoch(last_ts)) >= seconds""")
def due_updates(spark, sf_dir):
    """Series whose newest bar is a refresh interval of their timeframe old."""
    events = table(spark, sf_dir, "events").withColumn("timeframe", S.looked_up(F.col("event_type"), KIND_FRAMES, "1d"))
    last = events.groupBy(F.col("user_id").alias("instrument"), "timeframe").agg(F.max("ts").alias("last_ts"))
    return A.due(last, events.agg(F.max("ts").alias("now")))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%d %b') WHEN 'O' THEN strftime(o_orderdate, '%d.%m %H:%M') ELSE strftime(o_orderdate, '%H:%M') END AS label,
  epoch_us(o_orderdate) / 86400e6 AS day_number, CAST(epoch(date_trunc('day', (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow') AT TIME ZONE 'Europe/Moscow') AS BIGINT) AS day_start FROM orders""")
def time_labels(spark, sf_dir):
    code = F.when(F.col("o_orderstatus") == "F", "1d").when(F.col("o_orderstatus") == "O", "4h").otherwise("5m")
    ts = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.axis_label(code, ts).alias("label"), S.day_number(ts).alias("day_number"), S.day_start(ts).alias("day_start"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount * 100 AS y0, l_linenumber * 10.0 AS x1, l_tax * 100 AS y1 FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, round(least(x0, x1), 4) AS corner_x, round(least(y0, y1), 4) AS corner_y, round(abs(x1 - x0), 4) AS width, round(abs(y1 - y0), 4) AS height,
  round((x0 + x1) / 2, 4) AS tip_x, round(least(y0, y1) - abs(y1 - y0) / 2, 4) AS tip_y, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 4) AS radius FROM p""")
def pattern_shapes(spark, sf_dir):
    points = {"x0": F.col("l_quantity"), "y0": F.col("l_discount") * 100, "x1": F.col("l_linenumber") * F.lit(10.0), "y1": F.col("l_tax") * 100}
    out = A.shapes(table(spark, sf_dir, "lineitem").withColumns(points))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in ("corner_x", "corner_y", "width", "height", "tip_x", "tip_y", "radius")])


@query("""SELECT event_type, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS change, round(CASE WHEN arg_min(value, (ts, event_id)) > 0 THEN (arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / arg_min(value, (ts, event_id)) * 100 ELSE 0 END, 4) AS percent,
  count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20""")
def ticker_change(spark, sf_dir):
    """Change in value and percent of the kinds with the most events."""
    at = F.struct("ts", "event_id")
    ends = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("value", at).alias("o"), F.max_by("value", at).alias("c"), F.count(F.lit(1)).alias("n"))
    rows = ends.select("event_type", (F.col("c") - F.col("o")).alias("change"), F.round(S.zero_unless_positive(F.col("o"), F.col("c")), 4).alias("percent"), "n")
    return rows.orderBy(F.col("n").desc(), "event_type").limit(20)
