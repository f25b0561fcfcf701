"""Connections that fall silent: when they are closed and opened again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY, lag
from tidemark.operators.spans import SPAN, in_spans

# Seconds without a message after which a connection is closed, and from there to the next try.
LIMIT, WAIT = 60, 3


def silences(messages: DataFrame, limit: int = LIMIT, wait: int = WAIT, span: int = SPAN) -> DataFrame:
    """instrument, ts, closed_at, reopened_at, heard_at: each silence of a connection of more than limit
    seconds, ts being the message before it and heard_at the one that ends it. messages has instrument
    (the connection) and ts; messages at one time count as one."""
    rows = messages.select("instrument", F.lit("1m").alias(KEY[1]), F.col("ts").cast("timestamp_ntz").alias("ts")).distinct()
    rows = in_spans(rows, 1, lambda x: x.withColumn("before", lag(F.col("ts"))), span)
    after = lambda seconds: F.col("before") + F.make_dt_interval(secs=F.lit(seconds))
    found = rows.filter(F.col("ts") > after(limit))
    return found.select("instrument", F.col("before").alias("ts"), after(limit).alias("closed_at"), after(limit + wait).alias("reopened_at"), F.col("ts").alias("heard_at"))


def states(messages: DataFrame, now: DataFrame, limit: int = LIMIT, wait: int = WAIT) -> DataFrame:
    """instrument, ts and state of each connection at a time (now, one row and column): CONNECTED, or after a
    silence WAIT_RECONNECT until the next try is due, then RECONNECTING."""
    last = messages.groupBy("instrument").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("ts"))
    silent = F.unix_micros(now.scalar().cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    state = F.when(silent <= limit * 1_000_000, "CONNECTED").when(silent < (limit + wait) * 1_000_000, "WAIT_RECONNECT").otherwise("RECONNECTING")
    return last.select("instrument", "ts", state.alias("state"))
