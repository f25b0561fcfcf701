"""Stored metrics and bars: Parquet tables partitioned by timeframe and month, written idempotently.

A table is a folder that all executors reach. Rows are appended, or upserted on the table's keys: an
upsert reads and rewrites only the partitions that the new rows touch, and a batch that is written
twice changes nothing. New versions of partitions are written beside the table first, so a job that is
lost half-way leaves the old rows in place until the last step replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.rolling import KEY
from tidemark.operators.relational import upsert_latest
from tidemark.runtime import settle

PARTITIONS = ["timeframe", "month"]


@dataclass(frozen=True)
class Table:
    """schema without the month; keys tell rows apart; month is that of the column ts."""

    path: str
    schema: str
    keys: tuple[str, ...]

    def create(self, spark: SparkSession) -> Table:
        """Make the folder if there is none; an existing table stays as it is."""
        self.dated(spark.createDataFrame([], self.schema)).write.mode("append").partitionBy(*PARTITIONS).parquet(self.path)
        return self

    def full_schema(self) -> StructType:
        return StructType.fromDDL(f"{self.schema}, month string")

    def dated(self, rows: DataFrame, *more: Column) -> DataFrame:
        return rows.select(*StructType.fromDDL(self.schema).fieldNames(), F.date_format("ts", "yyyy-MM").alias("month"), *more)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows, with the month, by which time filters prune folders."""
        return spark.read.schema(self.full_schema()).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self.dated(rows).hint("rebalance", *PARTITIONS).write.mode("append").partitionBy(*PARTITIONS).parquet(self.path)

    def upsert(self, rows: DataFrame, version: Column | None = None) -> None:
        """Of rows with one key the last version stays; partitions without new rows aren't read."""
        spark = rows.sparkSession
        version = F.lit(0) if version is None else version
        new = settle(self.dated(rows, version.cast("long").alias("_version")), "upsert")
        touched = new.select(*PARTITIONS).distinct()
        old = self.rows(spark).join(touched, PARTITIONS, "left_semi")
        merged = settle(upsert_latest(new, old, [*self.keys, "month"], F.col("_version")), "merged")
        merged.hint("rebalance", *PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self.path)

    def read(self, spark: SparkSession, **equal) -> DataFrame:
        """The rows of these key values, in order of time, without the month."""
        found = self.rows(spark)
        for name, value in equal.items():
            found = found.filter(F.col(name) == F.lit(value))
        return found.drop("month").orderBy("ts")

    def latest(self, spark: SparkSession) -> DataFrame:
        """The time of the last row of each series."""
        return self.rows(spark).groupBy(*KEY).agg(F.max("ts").alias("last_ts"))


def metrics(path: str) -> Table:
    """Values of metrics: one for each series, kind, period, displacement and time."""
    return Table(path, "instrument string, timeframe string, metric string, period int, displacement int, ts timestamp_ntz, value double", ("instrument", "timeframe", "metric", "period", "displacement", "ts"))


def bars(path: str) -> Table:
    return Table(path, "instrument string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double", (*KEY, "ts"))


def with_parts(dma: DataFrame) -> DataFrame:
    """Displaced averages with period and displacement, cut from the metric's name DMA_{p}x{d}."""
    part = lambda k: F.regexp_extract("metric", r"^DMA_(\d+)x(\d+)$", k).cast("int")
    return dma.select(*KEY, F.lit("DMA").alias("metric"), part(1).alias("period"), part(2).alias("displacement"), "ts", "value")
