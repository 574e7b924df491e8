"""Matrix factorisations of sparse matrices in coordinate form (id, f, v)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import panels
from .iterate import written
from .relational import top_by

#: Features up to which the Gram matrix of the features is held by the driver.
GRAM_LIMIT = 4096


def _gram_of_features(x: DataFrame, rows_each: int = 512) -> tuple[list, np.ndarray]:
    """The features and X' X. Each partition holds whole rows and adds up their dense products, a block of rows at a
    time; the partitions' sums are added row by row. The result is as large as the vocabulary squared."""
    names = [r[0] for r in x.select("f").distinct().orderBy("f").collect()]
    n = len(names)
    order = np.array(names)

    def products(frames):
        import pandas as pd

        total, held = np.zeros((n, n)), None

        def add(frame):
            ids, row = np.unique(frame["id"].to_numpy(), return_inverse=True)
            col = np.searchsorted(order, frame["f"].to_numpy())
            for a in range(0, len(ids), rows_each):
                own = (row >= a) & (row < a + rows_each)
                block = np.zeros((min(rows_each, len(ids) - a), n))
                np.add.at(block, (row[own] - a, col[own]), frame["v"].to_numpy()[own])
                total[:] += block.T @ block

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            unfinished = (frame["id"] == frame["id"].iloc[-1]).to_numpy() if len(frame) else np.zeros(0, bool)
            held = frame[unfinished]
            add(frame[~unfinished])
        if held is not None and len(held):
            add(held)
            full = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"i": full, "row": list(total[full])})

    def added(frame):
        import pandas as pd

        return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.sum(frame["row"].to_list(), axis=0)]})

    g = np.zeros((n, n))
    if n:
        parts = x.select("id", "f", F.col("v").cast("double").alias("v")).repartition("id").sortWithinPartitions("id").mapInPandas(products, "i long, row array<double>")
        for i, row in parts.groupBy("i").applyInPandas(added, "i long, row array<double>").toPandas().itertuples(index=False):
            g[i] = row
    return names, g


def signs(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest magnitude (the first, of several) is positive."""
    if not v.size:
        return v
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def svd(x: DataFrame, k: int, left: bool = True) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(U: id, component, value), singular values, (V: f, component, value) of the k largest, without zeros.

    Vocabularies up to GRAM_LIMIT go through the Gram matrix of the features; larger ones through MLlib's distributed
    Lanczos iteration."""
    spark = x.sparkSession
    x = written(x.select("id", "f", F.col("v").cast("double").alias("v")), "svd")
    n = x.select("f").distinct().count()
    if n <= GRAM_LIMIT:
        names, g = _gram_of_features(x)
        values, vectors = np.linalg.eigh(g) if n else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values)[:k]
        s = np.sqrt(np.maximum(values[order], 0))
        keep = s > np.sqrt(4 * max(1, n) * np.finfo(float).eps) * max(1e-300, s.max(initial=0))  # below that, the Gram matrix holds rounding only
        s, v = s[keep], signs(vectors[:, order[keep]])
    else:
        from pyspark.mllib.linalg import SparseVector
        from pyspark.mllib.linalg.distributed import RowMatrix

        from .relational import dense

        codes = written(dense(x, "f", "j", start=0), "codes")
        names = [r[0] for r in codes.orderBy("j").select("f").collect()]
        rows = x.join(codes, "f").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
        matrix = RowMatrix(rows.select("e").rdd.map(lambda r: SparseVector(n, [e["j"] for e in r["e"]], [e["v"] for e in r["e"]])))
        found = matrix.computeSVD(min(k, n - 1))
        s, v = found.s.toArray(), signs(found.V.toArray())
    right = spark.createDataFrame([(f, c, float(v[i, c])) for i, f in enumerate(names) for c in range(len(s))], f"f {x.schema['f'].dataType.simpleString()}, component int, value double")
    u = x.join(F.broadcast(right) if n <= GRAM_LIMIT else right, "f").groupBy("id", "component").agg(F.sum(F.col("v") * F.col("value")).alias("_p"))
    scale = spark.createDataFrame([(c, float(a)) for c, a in enumerate(s)], "component int, s double")
    return (u.join(F.broadcast(scale), "component").select("id", "component", (F.col("_p") / F.col("s")).alias("value")) if left else None), s, right


def principal_components(x: DataFrame, k: int) -> tuple[np.ndarray, DataFrame]:
    """(variances, f component value) of the rows of x, absent entries being 0; sorted, with fixed signs."""
    names, g = _gram_of_features(x)
    n = x.select("id").distinct().count()
    at = {f: i for i, f in enumerate(names)}
    mean = np.zeros(len(names))
    for f, total in x.groupBy("f").agg(F.sum("v")).collect():
        mean[at[f]] = total / n
    values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(-values)[:k]
    v = signs(vectors[:, order])
    return values[order], x.sparkSession.createDataFrame([(f, c, float(v[i, c])) for i, f in enumerate(names) for c in range(v.shape[1])], f"f {x.schema['f'].dataType.simpleString()}, component int, value double")


def covariance_pairs(x: DataFrame, features: int) -> DataFrame:
    """i, j, cov between the rows of x over all its features, absent entries being 0; pairs that share no feature too are given by the means alone and are left to the caller."""
    means = x.groupBy("id").agg((F.sum("v") / features).alias("m"))
    a, b = x.alias("a"), x.alias("b")
    both = a.join(b, "f").groupBy(F.col("a.id").alias("i"), F.col("b.id").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("s"))
    both = both.join(means.toDF("i", "mi"), "i").join(means.toDF("j", "mj"), "j")
    return both.select("i", "j", ((F.col("s") - features * F.col("mi") * F.col("mj")) / (features - 1)).alias("cov"))


def members(v: DataFrame, key: str = "f") -> DataFrame:
    """Rows whose value reaches the mean of their component."""
    mean = F.avg("value").over(Window.partitionBy("component"))
    return v.withColumn("_mean", mean).filter(F.col("value") >= F.col("_mean")).drop("_mean").select(key, "component", "value")


def groups(u: DataFrame, key: str = "id", components: int = 3) -> DataFrame:
    """key, component: the component (of the first three) with the largest signed value; ties go to the first."""
    return top_by(u.filter(F.col("component") < components), 1, [key], F.desc("value"), F.asc("component")).select(key, "component")


def cosine_to_all(x: DataFrame, ids: DataFrame) -> DataFrame:
    """watched, id, cosine: of each of a bounded set of rows to all rows."""
    norm = x.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    q = x.join(F.broadcast(ids), "id", "left_semi").select(F.col("id").alias("watched"), "f", F.col("v").alias("q"))
    s = x.join(F.broadcast(q), "f").groupBy("watched", "id").agg(F.sum(F.col("v") * F.col("q")).alias("dot"))
    s = s.join(norm, "id").join(norm.toDF("watched", "watched_norm"), "watched")
    both = F.col("norm") * F.col("watched_norm")
    return s.filter(both > 0).select("watched", "id", (F.col("dot") / F.when(both > 0, both)).alias("cosine"))


def subspace(x: DataFrame, k: int, sweeps: int = 6, centre: bool = True, seed: int = 0) -> DataFrame:
    """f, q0 .. q(k-1): the k leading principal directions (or right singular vectors) by subspace iteration.

    Each sweep applies X'X (less n m m' with the features' means m) to k vectors by blocks; they are made
    orthonormal through their k x k Gram matrix, so nothing of the features' size reaches the driver."""
    return panels.subspace(x, k, sweeps, centre, seed)


def directions(x: DataFrame, k: int, sweeps: int = 6) -> DataFrame:
    """f, component, value: leading principal directions, exact for small vocabularies, by subspace iteration for others; signs as in `signs`."""
    if x.select("f").distinct().count() <= GRAM_LIMIT:
        return principal_components(x, k)[1]
    return components(subspace(x, k, sweeps), k)


def components(q: DataFrame, k: int) -> DataFrame:
    """f, component, value of the columns q0 .. q(k-1), each turned so that its entry of largest magnitude is positive."""
    names = [f"q{c}" for c in range(k)]
    largest = q.agg(*[F.max_by(c, F.struct(F.round(F.abs(c), 9), -F.col("f"))).alias(f"m{c}") for c in names])  # one row
    each = F.array(*[F.struct(F.lit(i).alias("component"), (F.col(c) * F.when(F.col(f"m{c}") < 0, -1.0).otherwise(1.0)).alias("value")) for i, c in enumerate(names)])
    return q.crossJoin(F.broadcast(largest)).select("f", F.explode(each).alias("e")).select("f", "e.component", "e.value")
