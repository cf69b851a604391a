"""Folders that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master without one gets a folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    path = "file://" + tempfile.mkdtemp(prefix="rankloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when the query ends. Else they stay until the driver happens to collect its garbage, and those
    of all steps of a run lie on disk together."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what is used several times runs once, and its lineage ends."""
    path = folder(df.sparkSession)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new path under the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/rankloom-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path
