"""Lookups, semi- and anti-joins, inserts and upserts, top-k, order books: plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.runtime import settle


def insert_absent(incoming: DataFrame, stored: DataFrame, keys: list[str], first_by: list[Column]) -> DataFrame:
    """stored and those incoming rows whose key it lacks; of incoming rows with one key the first by
    first_by. Running it again adds nothing."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*first_by))
    new = incoming.withColumn("rank", rank).filter("rank = 1").drop("rank").join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def upsert_latest(incoming: DataFrame, stored: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row for each key: the incoming one with the highest version, else the stored one. Keys
    compare null-safe. One exchange on the keys."""
    columns = stored.columns
    both = stored.withColumn("is_new", F.lit(0)).withColumn("version", F.lit(None).cast("long")).unionByName(incoming.select(*columns, F.lit(1).alias("is_new"), version.cast("long").alias("version")))
    rest = [x for x in columns if x not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("is_new", "version")).alias("row")).select(*keys, "row.*").select(*columns)


def top_k(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    """The k rows with the highest value: each task keeps k before they meet."""
    return df.orderBy(by.desc(), *ties).limit(k)


def top_k_per_group(df: DataFrame, group: str, by: Column, k: int, *ties: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(by.desc(), *ties))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def within_ratio(df: DataFrame, cap: str, reference: DataFrame, ratio: float = 5.0, fallback: float = 4e11) -> DataFrame:
    """Rows with a positive cap of at most the reference (one row, one column; the fallback where it is
    null or missing) over the ratio."""
    top = F.coalesce(reference.select(F.max(reference.columns[0])).scalar(), F.lit(fallback))
    return df.filter((F.col(cap) > 0) & (F.col(cap) <= top / ratio))


def largest_within_ratio(df: DataFrame, cap: str, tie: str, reference: DataFrame, ratio: float = 5.0, limit: int = 250, page: int = 250) -> DataFrame:
    """within_ratio of the largest ones: a source gives no more than a page, and is asked first."""
    return within_ratio(top_k(df, F.col(cap), min(limit, page), tie), cap, reference, ratio)


def updated(df: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """df with a new value in one column of the rows where a condition is true."""
    return df.withColumn(column, F.when(where, value.cast(df.schema[column].dataType)).otherwise(F.col(column)))


def run_sql(spark: SparkSession, sql: str, params: dict, **tables: DataFrame) -> DataFrame:
    """Parameterised SQL: :name stands for a parameter, {name} for a table."""
    return spark.sql(sql, args=params, **tables)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def book_levels(orders: DataFrame, price: str, amount: str, step: float, *keys: str) -> DataFrame:
    """Amounts summed at prices rounded to the step, ties to the even level."""
    return orders.groupBy(*keys, (F.bround(F.col(price) / step) * step).alias("level")).agg(F.sum(amount).alias("amount"))


def side_by_side(bids: DataFrame, asks: DataFrame, key: str) -> DataFrame:
    """Bids from the highest and asks from the lowest price, paired by their place in the book."""
    b = bids.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("level").desc())))
    a = asks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("level"))))
    b = b.select(key, "place", F.col("level").alias("bid"), F.col("amount").alias("bid_amount"))
    a = a.select(key, "place", F.col("level").alias("ask"), F.col("amount").alias("ask_amount"))
    return b.join(a, [key, "place"], "full_outer")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, bucket: str = "day") -> DataFrame:
    """Each left row with the latest right value at or before its time (the largest of one time), null
    if there is none: a union, a running last value inside each time bucket of a key, and what earlier
    buckets end with. So no key is expanded into pairs, and a key with many rows is many tasks' work."""
    kind = right.schema[value].dataType
    rows = left.select(*keys, ts, F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias(value))
    rows = rows.unionByName(right.filter(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias(value)), allowMissingColumns=True)
    rows = rows.withColumn("_bucket", F.date_trunc(bucket, F.col(ts).cast("timestamp")))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_of"), F.last("_end", True).over(before).alias("_carried")).filter("_carried is not null")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last(value, True).over(inside)).filter("_row is not null")
    same = [rows[k].eqNullSafe(ends[f"_{k}"]) for k in keys] + [rows["_bucket"].eqNullSafe(ends["_of"])]
    return rows.join(ends, same, "left").select("_row.*", F.coalesce("_last", "_carried").alias(value))


def with_new_ids(names: DataFrame, stored: DataFrame, name: str, key: str) -> DataFrame:
    """stored(key, name) and a row for each name that it lacks, whatever the case; new keys go on from
    the largest, in order of the names. Names are cut into ranges of about equal size; they are numbered
    inside a range, and a running sum over the few ranges tells where each begins."""
    offered = names.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("low")).agg(F.min(name).alias(name))
    fresh = offered.join(stored.select(F.lower(name).alias("low")), "low", "left_anti")
    ranges = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written down, as the bounds of the ranges come from a sample.
    fresh = settle(fresh.repartitionByRange(ranges, "low").withColumn("range", F.spark_partition_id()), "new-names")
    counts = fresh.groupBy("range").count()
    heads = counts.withColumn("before", F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count"))
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("top"))
    placed = fresh.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("low"))).join(heads.select("range", "before"), "range")
    numbered = placed.select((top.scalar() + F.col("before") + F.col("place")).alias(key), name)
    return stored.select(F.col(key).cast("long").alias(key), name).unionByName(numbered)


def newer_than_mark(incoming: DataFrame, stored: DataFrame, key: str, ts: str) -> DataFrame:
    """Incoming rows later than the last stored one of their key; all rows of a key not stored yet."""
    marks = stored.groupBy(F.col(key).alias("mark_key")).agg(F.max(ts).alias("mark"))
    return incoming.join(marks, F.col(key) == F.col("mark_key"), "left").filter(F.col("mark").isNull() | (F.col(ts) > F.col("mark"))).drop("mark_key", "mark")


def name_set(names: DataFrame, column: str) -> DataFrame:
    """The distinct names without regard to case, in lower case; null is no name."""
    return names.select(F.lower(column).alias(column)).filter(F.col(column).isNotNull()).distinct()


def unknown_names(candidates: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Candidates whose name isn't among the known ones in any case of letters; a null name is unknown."""
    seen = name_set(known, column).withColumnRenamed(column, "_known")
    return candidates.join(seen, F.lower(candidates[column]) == seen["_known"], "left_anti")


def page(rows: DataFrame, key: str, size: int, from_key=None, way: str = "next") -> DataFrame:
    """The rows after a key in ascending order, or with way "prev" those before it in descending order."""
    if way not in ("next", "prev"):
        raise ValueError(f"a page is next or prev, not {way}")
    k = F.col(key)
    beyond = F.lit(True) if from_key is None else k > from_key if way == "next" else k < from_key
    return rows.filter(beyond).orderBy(k.asc() if way == "next" else k.desc()).limit(size)
