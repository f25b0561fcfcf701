"""Session helpers that every part of the library shares."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_swept: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions pickled by
    reference resolve there even when the repository is not on their Python path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none and its master is this machine (tests) is a temporary folder set;
    on a cluster that would be a folder that executors don't see.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if found := sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/tidemark/{sc.applicationId}"
    if path not in _swept:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(sc._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
        _swept.add(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives the
    loss of executors and lets several consumers read one result, as long as the application runs."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
