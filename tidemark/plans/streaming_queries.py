"""Streaming queries: each runs its stream over the table's files and returns the merged rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.indicator_queries import r, rounded
from tidemark.plans.registry import query
from tidemark.runtime import work_dir, table
from tidemark.sources import store
from tidemark.sources.messages import routed
from tidemark.streaming import ingest

HOURLY = f"""SELECT event_type AS instrument, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, {r('arg_min(value, (ts, event_id))', 'open')}, {r('max(value)', 'high')},
  {r('min(value)', 'low')}, {r('arg_max(value, (ts, event_id))', 'close')}, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"""


def events_stream(spark, sf_dir):
    """The events as a stream. A glob of the one file, as a stream reads a folder or a pattern."""
    schema = table(spark, sf_dir, "events").schema
    return ingest.landing(spark, f"{sf_dir}/event[s].parquet", schema)


def ticks_of(events):
    return events.select(F.col("event_type").alias("instrument"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def fresh_dir(spark):
    return f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(HOURLY)
def stream_bars(spark, sf_dir):
    """Bars upserted into a stored table as their windows change."""
    top = fresh_dir(spark)
    bars = store.bars(f"{top}/bars")
    ingest.run_stored(ingest.tick_bars(ticks_of(events_stream(spark, sf_dir))), bars, f"{top}/checkpoint")
    return bars.rows(spark).select("instrument", "ts", *rounded("open", "high", "low", "close"), "volume")


@query("""WITH more AS (SELECT event_type AS instrument, ts - INTERVAL 3 DAY AS ts, value FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_type, ts + INTERVAL 1 DAY, value FROM events WHERE event_id % 5 = 1),
e AS (SELECT event_type AS instrument, ts, value FROM events UNION ALL SELECT * FROM more WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 1 DAY)
SELECT instrument, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS volume, round(max(value), 4) AS high FROM e GROUP BY 1, 2""")
def stream_late(spark, sf_dir):
    """A second file with ticks of three days before and a day after: those whose window ended before the
    watermark that the first file left (a day before its last tick) are dropped, the others count. The
    query is stopped between the two files and started again."""
    top, events = fresh_dir(spark), table(spark, sf_dir, "events")
    shifted = lambda of, days: events.filter(F.col("event_id") % 5 == of).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days)))
    bars = store.bars(f"{top}/bars")
    for k, part in enumerate((events, shifted(0, -3).unionByName(shifted(1, 1)))):
        part.write.mode("append").parquet(f"{top}/landing")
        stream = ingest.landing(spark, f"{top}/landing", events.schema, files_per_trigger=10_000)
        ingest.run_stored(ingest.tick_bars(ticks_of(stream)), bars, f"{top}/checkpoint")
    return bars.rows(spark).select("instrument", "ts", "volume", *rounded("high"))


@query("""WITH g AS (SELECT event_type AS instrument, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(begins) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT instrument, min(ts) AS ts, max(ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS n FROM s GROUP BY instrument, k""")
def stream_sessions(spark, sf_dir):
    """Runs of events without a gap of an hour."""
    return ingest.run_complete(ingest.session_bars(ticks_of(events_stream(spark, sf_dir)), "1 hour"))


@query("""WITH w AS (SELECT event_type AS instrument, CAST(date_trunc('hour', ts) AS TIMESTAMP) - k * INTERVAL 1 HOUR AS ts, value FROM events, (VALUES (0), (1), (2), (3)) AS v(k))
SELECT instrument, ts, round(max(value), 4) AS high, round(min(value), 4) AS low FROM w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Extremes of four hours, every hour."""
    return ingest.run_complete(ingest.sliding_bars(ticks_of(events_stream(spark, sf_dir)), "4 hours", "1 hour")).select("instrument", "ts", *rounded("high", "low"))


MESSAGES = (
    '{"status": "error", "err-code": "bad-request", "err-msg": "no", "ch": "x"}', '{"err-code": 2002, "op": "sub"}', '{"status": "ok", "op": "notify", "topic": "t"}', '{"op": "ping", "ts": 5}', '{"op": "auth"}',
    '{"action": "push", "ch": "accounts", "data": {"k": 1}}', '{"action": "push", "ch": "accounts"}', '{"action": "sub", "code": 200}', '{"action": "req", "code": 500}', '{"action": "ping", "data": {"ts": 3}}',
    '{"ch": "market.btcusdt.bbo", "tick": {"bid": 1.5}}', '{"rep": "market.btcusdt.bbo", "ping": 4}', '{"ping": 1492420473027}', '{"pong": 1}', "no json",
)
KINDS = ("error", "error", "data", "ping_trade", "auth", "data", "error", "ack", "error", "ping_account", "data", "answer", "ping_market", "unknown", "unknown")


@query(f"SELECT event_id, [{', '.join(repr(k) for k in KINDS)}][event_id % {len(KINDS)} + 1] AS kind, CASE event_id % {len(KINDS)} WHEN 0 THEN 'bad-request: no' WHEN 1 THEN '2002: Unknown error' WHEN 6 THEN 'Unknown error: Unknown error' WHEN 8 THEN 'Unknown error: Unknown error' END AS reason FROM events")
def stream_router(spark, sf_dir):
    """A message of some kind for each event, routed as it comes in."""
    body = F.get(F.array(*map(F.lit, MESSAGES)), F.col("event_id") % len(MESSAGES))
    return ingest.run_appended(routed(events_stream(spark, sf_dir).select("event_id", body.alias("body"))).select("event_id", "kind", "reason"))


@query("""WITH d AS (SELECT event_id % 4 AS book, event_id AS seq, floor(value) AS price, event_id % 3 = 0 AS removes, event_id // 4 % 50 = 49 AS gap FROM events),
last_gap AS (SELECT book, coalesce(max(seq) FILTER (gap), -1) AS since, count(*) FILTER (gap) AS n_gaps, max(seq) AS seq FROM d GROUP BY 1),
last AS (SELECT d.book, price, arg_max(removes, d.seq) AS removed FROM d JOIN last_gap g ON g.book = d.book AND d.seq >= since GROUP BY 1, 2)
SELECT CAST(g.book AS VARCHAR) AS symbol, g.seq, CAST((SELECT count(*) FROM last l WHERE l.book = g.book AND NOT removed) AS INTEGER) AS n_levels, n_gaps FROM last_gap g""")
def stream_order_book(spark, sf_dir):
    """Deltas applied to four books in the stream's state. Every fiftieth delta of a book names a
    predecessor that wasn't there, so the book begins anew."""
    seq = F.col("event_id")
    rows = events_stream(spark, sf_dir).select((seq % 4).cast("string").alias("symbol"), seq.alias("seq"), F.floor("value").cast("double").alias("price"), F.when(seq % 3 == 0, 0.0).otherwise(1.0).alias("amount"))
    prev = F.when(F.expr("seq div 4") % 50 == 49, F.col("seq") - 5).otherwise(F.col("seq") - 4)
    deltas = rows.select("symbol", "seq", prev.alias("prev"), F.array("price").alias("prices"), F.array("amount").alias("amounts"))
    out = ingest.run_appended(ingest.order_books(deltas))
    return out.groupBy("symbol").agg(F.max("seq").alias("seq"), F.max_by("n_levels", "seq").alias("n_levels"), F.count_if("gap").alias("n_gaps"))
