"""Structured Streaming: landing files to bars, idempotent merges, and order books from deltas."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from tidemark.runtime import settle, work_dir, ship
from tidemark.sources import store

BOOK_SCHEMA = "symbol string, seq long, n_levels int, gap boolean"
BOOK_STATE = "last long, prices array<double>, amounts array<double>"


def landing(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder or are a single file's name pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tick_bars(ticks: DataFrame, timeframe: str = "1h", length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Bars of ticks(instrument, ts, seq, price, volume) by tumbling windows under a watermark: ticks of a
    window that ended before it are dropped, and its state with them."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = rows.groupBy("instrument", F.window("ts", length).alias("w")).agg(
        F.min_by("price", F.struct("ts", "seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select("instrument", F.lit(timeframe).alias("timeframe"), F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def session_bars(ticks: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """instrument, ts, end_ts and number of ticks of each run of ticks without a gap of that length."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    runs = rows.groupBy("instrument", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return runs.select("instrument", F.col("w.start").cast("timestamp_ntz").alias("ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n")


def sliding_bars(ticks: DataFrame, length: str, step: str, late: str = "1 day") -> DataFrame:
    """instrument, ts, high and low of windows of that length that begin at every step."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = rows.groupBy("instrument", F.window("ts", length, step).alias("w")).agg(F.max("price").alias("high"), F.min("price").alias("low"))
    return bars.select("instrument", F.col("w.start").cast("timestamp_ntz").alias("ts"), "high", "low")


def run_stored(stream: DataFrame, stored: store.Table, checkpoint: str) -> None:
    """Run a stream of changed rows over all that is there, each micro-batch upserting into a stored
    table with its number as version. The table and the checkpoint are fixed folders: a query that is
    started again goes on where the last one ended, and a batch that runs again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        stored.upsert(batch, F.lit(number))

    stored.create(stream.sparkSession)
    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def run_complete(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there and return what its groups ended with."""
    spark = stream.sparkSession
    top = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: dict[str, DataFrame] = {}

    def keep(batch: DataFrame, number: int) -> None:
        last["rows"] = settle(batch, "complete")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return last.get("rows", spark.createDataFrame([], stream.schema))


class Failures(StreamingQueryListener):
    """Keeps the id and the error of streams that end with one, and tells a handler of each."""

    def __init__(self, handler=None):
        self.found: list[tuple[str, str]] = []
        self.handler = handler

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception is not None:
            self.found.append((str(event.id), event.exception))
            if self.handler:
                self.handler(event.exception)


def start_updates(stream: DataFrame, stored: store.Table, checkpoint: str, every: str = "60 seconds"):
    """Upsert a stream into a stored table in the background, at this pace, until the query is stopped."""
    stored.create(stream.sparkSession)
    merge = lambda batch, number: stored.upsert(batch, F.lit(number))
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(merge).start()


def run_appended(stream: DataFrame) -> DataFrame:
    """Run an append stream over all that is there and read its files back."""
    spark = stream.sparkSession
    top = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def apply_delta(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Apply deltas in sequence: an amount of 0 removes its level, a missing predecessor is a gap
    that empties the book first."""
    last, prices, amounts = state.get if state.exists else (None, [], [])
    book = dict(zip([] if prices is None else prices, [] if amounts is None else amounts, strict=True))
    out = []
    for row in pd.concat(list(frames)).sort_values("seq").itertuples():
        if last is not None and row.seq <= last:
            continue
        # A feed without predecessors (null) has no gaps.
        gap = last is not None and not pd.isna(row.prev) and row.prev != last
        if gap:
            book.clear()
        for price, amount in zip(row.prices, row.amounts, strict=True):
            if amount == 0:
                book.pop(float(price), None)
            else:
                book[float(price)] = float(amount)
        last = int(row.seq)
        out.append((key[0], last, len(book), gap))
    state.update((last, [float(x) for x in book], [float(x) for x in book.values()]))
    yield pd.DataFrame(out, columns=["symbol", "seq", "n_levels", "gap"])


def order_books(deltas: DataFrame) -> DataFrame:
    """The number of levels after each delta of deltas(symbol, seq, prev, prices, amounts)."""
    ship(deltas.sparkSession)
    return deltas.groupBy("symbol").applyInPandasWithState(apply_delta, BOOK_SCHEMA, BOOK_STATE, "append", "NoTimeout")
