"""Random walks with restart, over matrices that are never formed.

A similarity matrix S = X X' of sparse vectors is applied as two joins with X per step, so a step costs as much as X has
entries, where S would have their square."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import written


def apply_gram(x: DataFrame, p: DataFrame) -> DataFrame:
    """id, p of X X' p. x: id, f, v; p: id, p."""
    y = x.join(p, "id").groupBy("f").agg(F.sum(F.col("v") * F.col("p")).alias("y"))
    return x.join(y, "f").groupBy("id").agg(F.sum(F.col("v") * F.col("y")).alias("p"))


def seeds(spark, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(i), 1.0 / len(ids)) for i in sorted(set(ids))], "id long, p0 double")


def restart_walk(x: DataFrame, start: DataFrame, restart: float = 0.85, tolerance: float | None = 1e-5, steps: int = 100, normalize: bool = True) -> DataFrame:
    """id, p: p = (1 - restart) S p + restart p0, until the L1 change is at most the tolerance, or for `steps` steps.

    S has its columns scaled to sum 1, or is used as it is with normalize=False (then p needn't converge)."""
    x = written(x.select("id", "f", F.col("v").cast("double").alias("v")), "walk-x")
    ids = x.select("id").distinct()
    base = ids.join(start, "id", "left").select("id", F.coalesce("p0", F.lit(0.0)).alias("p0"))
    if normalize:
        base = base.join(apply_gram(x, ids.withColumn("p", F.lit(1.0))).withColumnRenamed("p", "col"), "id")
    else:
        base = base.withColumn("col", F.lit(1.0))
    base = written(base, "walk-base")
    p = base.select("id", F.col("p0").alias("p"))
    for step in range(steps):
        scaled = p.join(base, "id").select("id", F.when(F.col("col") != 0, F.col("p") / F.when(F.col("col") != 0, F.col("col"))).otherwise(F.lit(0.0)).alias("p"))
        moved = apply_gram(x, scaled).withColumnRenamed("p", "m")
        both = base.join(moved, "id", "left").join(p, "id").select("id", ((1 - restart) * F.coalesce("m", F.lit(0.0)) + restart * F.col("p0")).alias("q"), "p")
        if tolerance is None:
            p = both.select("id", F.col("q").alias("p"))
            if step % 3 == 2:
                p = written(p, "walk")
            continue
        both = written(both, "walk")
        p = both.select("id", F.col("q").alias("p"))
        if both.agg(F.sum(F.abs(F.col("q") - F.col("p")))).first()[0] <= tolerance:
            break
    return p


def _summed(rows: DataFrame, shape: tuple[int, ...], part: Callable) -> list[np.ndarray]:
    """Sums, over all rows (id, j, u, p0), of the matrices of `shape` that `part(ids, j, u, first, p0)` gives for some of them. first: where rows begin."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            for found in _rows(batch):
                total += part(*found)
        full = np.flatnonzero(total.any(1))
        for k in range(0, len(full), 512):
            own = full[k : k + 512]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(total[own]), pa.list_(pa.float64()))], ["k", "row"])

    def added(frame):
        import pandas as pd

        return pd.DataFrame({"k": frame["k"].iloc[:1], "row": [np.sum(frame["row"].to_list(), axis=0)]})

    out = np.zeros(shape)
    for k, row in rows.mapInArrow(run, "k long, row array<double>").groupBy("k").applyInPandas(added, "k long, row array<double>").toPandas().itertuples(index=False):
        out[k] = row
    return out


def _rows(batch, rows_each: int = 512):
    """ids, j, u, the places where rows begin, p0 of a batch's rows, some at a time."""
    for k in range(0, batch.num_rows, rows_each):
        own = {c: batch.column(i).slice(k, rows_each) for i, c in enumerate(batch.schema.names)}
        yield own["id"].to_numpy(zero_copy_only=False), own["j"].flatten().to_numpy(), own["u"].flatten().to_numpy(), np.diff(own["j"].offsets.to_numpy()), own["p0"].to_numpy(zero_copy_only=False)


def _dense(j: np.ndarray, v: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((len(sizes), n))
    x[np.repeat(np.arange(len(sizes)), sizes), j] = v
    return x


def bounded_walk(
    rows: DataFrame, n: int, start: DataFrame, weigh: Callable, restart: float = 0.85, tolerance: float | None = 1e-5, steps: int = 100, normalize: bool = True
) -> DataFrame:
    """`restart_walk` for n features that the driver can hold the square of. rows: id, j (array of features from 0, none twice), u (array of numbers, `weigh(j, u, sizes)` gives their values).

    With p = (1 - restart) X y + restart p0 and y = X' D p, D being the columns' scale, the steps need only the n x n
    matrix X' D X: the rows are read to make it, once more for the changes of all steps, and for the last p."""
    rows = rows.join(start, "id", "left").select("id", "j", "u", F.coalesce("p0", F.lit(0.0)).alias("p0"))

    def columns(ids, j, u, sizes, p0):
        return np.bincount(j, weigh(j, u, sizes), n)[:, None]

    every = _summed(rows, (n, 1), columns)[:, 0] if normalize else None

    def products(ids, j, u, sizes, p0):
        x = _dense(j, weigh(j, u, sizes), sizes, n)
        col = x @ every if normalize else np.ones(len(x))
        d = np.divide(1.0, col, out=np.zeros(len(x)), where=col != 0)
        return x.T @ np.column_stack([x * d[:, None], d * p0])

    both = _summed(rows, (n, n + 1), products)
    h, b = both[:, :n], both[:, n]
    y = [b]
    for _ in range(steps):
        y.append((1 - restart) * (h @ y[-1]) + restart * b)
    last = steps
    if tolerance is not None:
        moves = np.column_stack([y[0], *[y[t] - y[t - 1] for t in range(1, steps)]])

        def changes(ids, j, u, sizes, p0):
            moved = _dense(j, weigh(j, u, sizes), sizes, n) @ moves
            moved[:, 0] -= p0
            return np.abs(moved).sum(0)[:, None]

        small = np.flatnonzero((1 - restart) * _summed(rows, (steps, 1), changes)[:, 0] <= tolerance)
        last = int(small[0]) + 1 if len(small) else steps
    if not last:
        return rows.select("id", F.col("p0").alias("p"))
    return _placed(rows, (1 - restart) * y[last - 1], weigh, restart)


def _placed(rows: DataFrame, final: np.ndarray, weigh: Callable, restart: float) -> DataFrame:
    """id, p = X final + restart p0."""

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, j, u, sizes, p0 in _rows(batch):
                row = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(row, weigh(j, u, sizes) * final[j], len(sizes)) + restart * p0)], ["id", "p"])

    return rows.mapInArrow(places, "id long, p double")


def bounded_covariance_walk(rows: DataFrame, n: int, start: DataFrame, restart: float = 0.85, steps: int = 20) -> DataFrame:
    """`covariance_walk` for n features, two at least, that the driver can hold the square of. rows: id, j (array of features from 0, none twice), u (array of values).

    With y = X' p the means' product m . p is sum(y) / n, so a step gives X z + restart p0 with z = (1 - restart) (y - sum(y) / n) / (n - 1),
    and the next y needs only X' X: the rows are read to make it and for the last p."""
    rows = rows.join(F.broadcast(start), "id", "left").select("id", "j", "u", F.coalesce("p0", F.lit(0.0)).alias("p0"))

    def products(ids, j, u, sizes, p0):
        x = _dense(j, u, sizes, n)
        return x.T @ np.column_stack([x, p0])

    both = _summed(rows, (n, n + 1), products)
    h, b = both[:, :n], both[:, n]
    y, z = b, np.zeros(n)
    for _ in range(steps):
        z = (1 - restart) * (y - y.sum() / n) / (n - 1)
        y = h @ z + restart * b
    return _placed(rows, z, lambda j, u, sizes: u, restart if steps else 1.0)


def covariance_walk(x: DataFrame, features: DataFrame, start: DataFrame, restart: float = 0.85, steps: int = 20) -> DataFrame:
    """The same on the covariance between entities, applied as (X X' p - T m (m . p)) / (T - 1), with m the row means over the T features; no scaling, a fixed number of steps."""
    x = written(x.select("id", "f", F.col("v").cast("double").alias("v")), "walk-x")
    t = float(features.count())
    means = x.groupBy("id").agg((F.sum("v") / t).alias("m"))
    base = written(means.join(start, "id", "left").select("id", "m", F.coalesce("p0", F.lit(0.0)).alias("p0")), "walk-base")
    p = base.select("id", F.col("p0").alias("p"))
    for step in range(steps):
        inner = F.broadcast(base.join(p, "id").agg(F.sum(F.col("m") * F.col("p")).alias("mp")))
        moved = apply_gram(x, p).withColumnRenamed("p", "s")
        p = base.join(moved, "id", "left").crossJoin(inner).select("id", ((1 - restart) * (F.coalesce("s", F.lit(0.0)) - t * F.col("m") * F.col("mp")) / (t - 1) + restart * F.col("p0")).alias("p"))
        if step % 3 == 2 or step == steps - 1:
            p = written(p, "walk")
    return p
