"""Session helpers: shared working tables, sizes, and the packed exchange that several operators use."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.iterate import work_dir

#: Largest table, in bytes of memory, that an operator may broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Most bytes of an Arrow batch of texts.
ARROW_BYTES = 6 << 20


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


class Table:
    """A DataFrame written to the shared folder: lineage ends here, and a lost executor costs one task's reading."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{work_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def bytes(self) -> int:
        return table_bytes(self.spark, self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def memory_bytes(df: DataFrame) -> int:
    """About the memory that the rows take: 8 bytes and the content's length for each value."""

    def width(c: str, kind: T.DataType):
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            fields = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
            return F.greatest(F.size(F.col(f"`{c}`")), F.lit(0)) * (16 + 8 * fields) + 24
        return F.lit(8)

    each = sum((width(f.name, f.dataType).cast("long") for f in df.schema.fields), F.lit(16).cast("long"))
    return df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def hinted(table: Table, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, broadcast if both its written size and the memory that its rows take are under the limit, else left to a shuffle join."""
    return F.broadcast(table.df) if table.bytes <= limit and memory_bytes(table.df) <= limit else table.df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's bytes per Arrow batch to `ARROW_BYTES` where they are more: a batch is held by the JVM and by
    the Python worker at once, and by default takes up to 64 MB on each side. One longer text is still one batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df


def fixed(f, *rest):
    """f with all arguments fixed but its first: Spark counts a function's parameters."""
    return lambda first: f(first, *rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input's size; 0 where it has none."""
    try:
        found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:
        return 0
    return found if found < 1 << 60 else 0


def text_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]


def bucket_count(df: DataFrame, bytes_each: int = 64 << 20, column: str = "text") -> int:
    """Buckets of a packed exchange: a few per shuffle partition, and enough that each stays small at any input size. Without an estimate the texts are measured."""
    size = 4 * estimated_bytes(df) or 2 * text_bytes(df, column)
    return max(4 * partitions(df.sparkSession), math.ceil(size / bytes_each))
