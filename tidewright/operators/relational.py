"""Relational primitives that several queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounds(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with global aggregates on each row: one row is computed and broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))


def with_value(df: DataFrame, **value: Column) -> DataFrame:
    return df.withColumns(value)


def share(df: DataFrame, weight: str, *by: str) -> Column:
    """weight over its sum within `by`."""
    return F.col(weight) / F.sum(weight).over(Window.partitionBy(*by))


def share_of_all(df: DataFrame, weight: str, name: str) -> DataFrame:
    """Adds weight over its global sum, without a single-partition window."""
    total = df.agg(F.sum(weight).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.col(weight) / F.col("_total")).drop("_total")


def genre_is(pattern: str, literal: bool = True) -> Column:
    """Genres hold the text (or match the regular expression) anywhere, so `Brand#1` also matches `Brand#13`."""
    return F.col("genres").contains(pattern) if literal else F.col("genres").rlike(pattern)


def genre_is_any(*patterns: str) -> Column:
    found = genre_is(patterns[0])
    for p in patterns[1:]:
        found |= genre_is(p)
    return found


def genres(movies: DataFrame) -> DataFrame:
    """movieid, genre: one row per entry of the list."""
    return movies.select("movieid", F.explode(F.split("genres", "[|]")).alias("genre"))


def dense(df: DataFrame, key: str, code: str, start: int = 1, buckets: int = 256) -> DataFrame:
    """Distinct keys in ascending order with codes start, start + 1, ...

    Ranges of keys are numbered in parallel: rows get a range by sorting, ranges get offsets from their counts."""
    ids = df.select(key).distinct().repartitionByRange(buckets, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    local = ids.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = local.groupBy("_part").agg(F.max("_n").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per range
    return local.join(F.broadcast(before.drop("_size")), "_part").select(key, (F.col("_n") + F.col("_before") - 1 + start).cast("long").alias(code))


def top_by(df: DataFrame, n: int, by: Sequence[str], *order: Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def argmax(df: DataFrame, by: str, value: str, pick: str) -> DataFrame:
    """by, and the pick of its largest value; ties go to the smallest pick."""
    return df.groupBy(by).agg(F.max_by(pick, F.struct(F.col(value), -F.col(pick))).alias(pick))


def majority(df: DataFrame, by: str, label: str, similarity: str) -> DataFrame:
    """The most frequent label; ties go to the one with the best similarity, then to the least."""
    votes = df.groupBy(by, label).agg(F.count("*").alias("_votes"), F.max(similarity).alias("_best"))
    return top_by(votes, 1, [by], F.desc("_votes"), F.desc("_best"), F.asc(label)).select(by, label)


def clamp_infinite(df: DataFrame, value: str) -> DataFrame:
    """Infinities become the largest and the smallest finite value."""
    inf = float("inf")
    finite = F.when(F.abs(F.col(value)) != inf, F.col(value))
    low_high = df.agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    fixed = F.when(F.col(value) == inf, F.col("_high")).when(F.col(value) == -inf, F.col("_low")).otherwise(F.col(value))
    return df.crossJoin(F.broadcast(low_high)).withColumn(value, fixed).drop("_low", "_high")


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg((F.avg((F.col(actual) == F.col(predicted)).cast("double")) * 100).alias("accuracy"))
