"""The tables of a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import table


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables in a folder, by Hadoop's file systems."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().getName().removesuffix(".parquet") for x in found if x.getPath().getName().endswith(".parquet"))


def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    """name and n of every table of a folder."""
    parts = [table(spark, folder, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in table_names(spark, folder)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "name string, n long")


def sample(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first rows by a key, to look at."""
    return df.orderBy(key).limit(n)
