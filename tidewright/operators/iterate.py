"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import gc
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "/tmp/checkpoints/tidewright"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_registered: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tidewright/{spark.sparkContext.applicationId}"
    if path not in _registered:
        _registered.add(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df, written to the folder that all executors share and read again."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` returned, once nothing reads it any more, and lets Spark drop the shuffle files of plans that are gone."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing holds any more."""
    gc.collect()
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)  # what the JVM still holds for Python, until a thread that mostly sleeps tells it
    while dropped:
        try:
            client, name = dropped.pop()
        except (IndexError, TypeError, ValueError):  # the thread took the last one, or the session ends
            break
        client.garbage_collect_object(name, False)
    for pause in (0.2, 0):  # what a first collection finds unused can hold plans until the next one
        try:
            spark._jsc.sc().listenerBus().waitUntilEmpty(5000)  # listeners of a query that just ended hold its plan
        except Py4JError:
            pass
        spark._jvm.System.gc()
        time.sleep(pause)


def in_small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 6 MB from now on: a row may hold two blocks."""
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= 6 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(6 << 20))
