"""Cutting lineage for iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a session on one machine makes its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (named := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = named.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mnemolake-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove, spark, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends."""
    path = f"{folder(spark)}/mnemolake/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def state_of(spark: SparkSession, path: str) -> tuple:
    """The files of a path with their lengths and times: another tuple when the table has changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: no lineage, and sizes that the planner knows instead of estimates of estimates."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `cut` made and that nothing lazy reads any more; let the JVM release the shuffle files of what made them."""
    for t in tables:
        _remove(t.sparkSession, t.scratch_path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the cluster cleans its own folder
        return
