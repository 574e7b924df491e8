"""Connected components of an edge table.

A table whose measured size is small is labelled in one task on an executor, in numpy; a larger one by alternating
large-star and small-star steps, which are joins and aggregations without unbounded groups. Both give the same labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


#: Bytes of an edge table, as written, that one task labels.
ONE_TASK = 32 << 20


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, smallest name of the component of each)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return names, names[label]
        label = new


def _in_one_task(batches):
    got = [b for b in batches if b.num_rows]
    if got:
        table = pa.Table.from_batches(got)
        names, least = labels(table.column("u").to_numpy(), table.column("v").to_numpy())
        moved = names != least
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(least[moved])], names=["u", "v"])


def connected(edges: DataFrame, one_task: int = ONE_TASK) -> Table:
    """u, v (long) with v the smallest member of u's component, for each u that isn't the smallest itself."""
    clean = edges.filter("u != v").distinct()
    table, state = Table(clean, "edges"), None
    if table.bytes <= one_task:
        return Table(table.df.coalesce(1).mapInArrow(_in_one_task, "u long, v long"), "labels")
    while True:
        stepped = Table(_small_star(_large_star(table.df)).filter("u != v").distinct(), "edges")
        now = stepped.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        table.drop()
        table = stepped
        if state is not None and tuple(now) == state:
            return table
        state = tuple(now)
