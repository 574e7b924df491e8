"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are cut into blocks of successive ids; a block keeps its forward index (the vectors) and, per term (component),
its largest and smallest value. For one query the summed term maxima (a component of the query times the block's
largest or smallest value, whichever gives more) bound every score in the block. Blocks are taken in falling order of
this bound; a query stops when the next bound is below its k-th score.

Blocks lie in strips of bounded size, queries in packed batches, so neither side is collected or broadcast. A first pass
over one strip per batch gives every query a k-th score to start from. Then batches meet the strips' own bounds (two
numbers a term, in pages), and of a batch only the queries whose k-th score a strip's bound reaches are shipped to it.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; a
query has no result from rows with its own id, and rows that repeat an id are one query (with the smallest of
their vectors); shorter vectors count as padded with zeros; fewer candidates than k give all; ties go to the smaller id. Components whose
scores may not fit 64 bits are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Table

BLOCK = 256
STRIP_ROWS = 8192
BATCH_ROWS = 2048
_EXACT = float(1 << 53)
_PACKED = "ids binary, dim int, cells binary, high binary, low binary"
#: Strips whose bounds are compared with a batch at once.
PAGE = 256
_PART = pa.schema([("strip", pa.int32()), ("q_ids", pa.binary()), ("q_dim", pa.int32()), ("q_cells", pa.binary()), ("least", pa.binary())])
_HITS = "query_id long, vec_id long, score long"


def quantised(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; what doesn't fit 64 bits is refused."""
    fits = lambda x: F.abs(x.cast("double") * factor) < float(1 << 63)
    return F.transform(embedding, lambda x: F.when(fits(x), F.floor(x.cast("double") * factor).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("long")))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = lists.to_pylist()
    dim = max(map(len, rows), default=0)
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _pack(table: pa.Table) -> tuple[bytes, int, bytes]:
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    m = _matrix(table.column("v"))[order]
    return ids[order].astype("<i8").tobytes(), m.shape[1], m.astype("<i8").tobytes()


def _unpack(ids: bytes, dim: int, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(cells, "<i8").reshape(len(i), dim)


def _kind(queries: np.ndarray, vectors: np.ndarray):
    """The number type in which scores of these are exact; refuses those that may not fit 64 bits."""
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * max(1, queries.shape[1])
    if largest >= float(1 << 63):
        raise OverflowError("components are too large for 64-bit scores")
    return np.float64 if largest < _EXACT else np.int64  # floats are exact below 2^53


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The summed term maxima: no score of a query with a vector between low and high is larger."""
    dim = max(queries.shape[1], high.shape[1])
    q, high, low = (_wide(x, dim) for x in (queries, high, low))
    kind = _kind(q, np.maximum(np.abs(high), np.abs(low)))
    return np.maximum(q, 0).astype(kind) @ high.T.astype(kind) + np.minimum(q, 0).astype(kind) @ low.T.astype(kind)


def search(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's best k of one strip, none below `least` of its query."""
    dim = max(queries.shape[1], vectors.shape[1])
    queries, vectors = _wide(queries, dim), _wide(vectors, dim)
    kind = _kind(queries, vectors)
    q, v = queries.astype(kind), vectors.astype(kind)
    edges = np.arange(0, len(v), block)
    high, low = np.maximum.reduceat(v, edges), np.minimum.reduceat(v, edges)
    most = bounds(queries, high.astype(np.int64), low.astype(np.int64))
    order = np.argsort(-most, axis=1, kind="stable")
    floor = least.astype(np.int64)
    best = np.full((len(q), k), np.iinfo(np.int64).min)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for turn in range(len(edges)):
        at = order[live, turn]
        on = most[live, at] >= np.maximum(floor[live], best[live, k - 1])
        live, at = live[on], at[on]
        if not len(live):
            break
        for b in np.unique(at):
            rows = live[at == b]
            part = slice(edges[b], edges[b] + block)
            s = (q[rows] @ v[part].T).astype(np.int64)
            own = ids[part][None, :] == query_ids[rows][:, None]
            s[own] = np.iinfo(np.int64).min
            all_s = np.concatenate([best[rows], s], 1)
            all_i = np.concatenate([best_id[rows], np.where(own, np.iinfo(np.int64).max, ids[part][None, :])], 1)
            top = np.lexsort((all_i, -all_s.astype(np.float64) if kind is np.float64 else np.negative(np.maximum(all_s, -(2**63) + 1))), axis=1)[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
    row, col = np.nonzero((best >= floor[:, None]) & (best > np.iinfo(np.int64).min))
    return row, best_id[row, col], best[row, col]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, strip_rows: int = STRIP_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: id, v (array of long); is_query: a condition on `id`."""
    spark = vectors.sparkSession
    cells = Table(vectors, "vectors")
    strips_n = max(1, -(-cells.df.count() // strip_rows))
    query_rows = cells.df.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    batches_n = max(1, -(-query_rows.count() // batch_rows))

    def packed(n: int, name: str):
        def run(batches):
            got = [b for b in batches if b.num_rows]
            if got:
                table = pa.Table.from_batches(got)
                at = np.sort(table.column("part").to_numpy())
                for p in np.unique(at):
                    own = table.filter(pa.array(table.column("part").to_numpy() == p))
                    ids, dim, values = _pack(own)
                    m = _unpack(ids, dim, values)[1]
                    yield pa.RecordBatch.from_pydict({name: pa.array([p], pa.int32()), "ids": [ids], "dim": pa.array([dim], pa.int32()), "cells": [values], "high": [m.max(0).tobytes()], "low": [m.min(0).tobytes()]})

        return run

    # successive ids share a strip, so the ranges of its blocks are ranges of ids
    by_range = cells.df.repartitionByRange(strips_n, "id").withColumn("part", F.spark_partition_id())
    strips = Table(by_range.mapInArrow(packed(strips_n, "strip"), f"strip int, {_PACKED}"), "strips")
    dealt = query_rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(batches_n)).cast("int")).repartition(batches_n, "part")
    queries = Table(dealt.mapInArrow(packed(batches_n, "batch"), f"batch int, {_PACKED}"), "queries").df.select("batch", F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("cells").alias("q_cells"))
    there = strips.df.agg(F.collect_set("strip").alias("there"))  # as many numbers as strips

    def score(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, v = _unpack(r["ids"], r["dim"], r["cells"])
                q_ids, q = _unpack(r["q_ids"], r["q_dim"], r["q_cells"])
                least = np.frombuffer(r["least"], "<i8") if r.get("least") else np.full(len(q_ids), np.iinfo(np.int64).min)
                row, hit, s = search(q, q_ids, least, ids, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(hit), pa.array(s)], names=["query_id", "vec_id", "score"])

    first = queries.join(F.broadcast(there)).withColumn("strip", F.element_at("there", (F.col("batch") % F.size("there") + 1).cast("int")))
    homes = first.select("batch", F.col("strip").alias("home"))
    seeds = Table(first.drop("there").join(strips.df, "strip").mapInArrow(score, _HITS), "seeds")
    kth = seeds.df.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))

    def with_least(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, known = np.frombuffer(r["q_ids"], "<i8"), dict(zip(r["known_ids"] or [], r["known"] or [], strict=True))
                low = np.array([known.get(int(i), np.iinfo(np.int64).min) for i in ids], "<i8")
                r["least"] = low.tobytes()
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("batch", "q_ids", "q_dim", "q_cells", "least")}], pa.schema([("batch", pa.int32()), ("q_ids", pa.binary()), ("q_dim", pa.int32()), ("q_cells", pa.binary()), ("least", pa.binary())]))

    by_batch = kth.filter("kth is not null").withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches_n)).cast("int")).groupBy("batch").agg(F.collect_list("query_id").alias("known_ids"), F.collect_list("kth").alias("known"))  # a batch's queries
    ready = queries.join(by_batch, "batch", "left").mapInArrow(with_least, "batch int, q_ids binary, q_dim int, q_cells binary, least binary")
    def choose(batches):
        """Of a batch and the bounds of some strips: for each strip the queries whose k-th score its bound reaches."""
        for b in batches:
            for r in b.to_pylist():
                ids, q = _unpack(r["q_ids"], r["q_dim"], r["q_cells"])
                least, strips_ = np.frombuffer(r["least"], "<i8"), [x for x in r["page"] if x["strip"] != r["home"]]
                dim = max((x["dim"] for x in strips_), default=0)
                high, low = (np.array([np.pad(np.frombuffer(x[c], "<i8"), (0, dim - x["dim"])) for x in strips_], np.int64).reshape(len(strips_), dim) for c in ("high", "low"))
                may = bounds(q, high, low) >= least[:, None] if strips_ else np.zeros((len(q), 0), bool)
                for n in np.flatnonzero(may.any(0)):
                    on = may[:, n]
                    yield pa.RecordBatch.from_pylist([{"strip": strips_[n]["strip"], "q_ids": ids[on].tobytes(), "q_dim": r["q_dim"], "q_cells": q[on].tobytes(), "least": least[on].tobytes()}], _PART)

    pages = strips.df.select("strip", "dim", "high", "low").groupBy(F.floor(F.col("strip") / PAGE).alias("p")).agg(F.collect_list(F.struct("strip", "dim", "high", "low")).alias("page"))  # PAGE strips
    pages = Table(pages.select("page"), "pages")
    grid = ready.join(homes, "batch").crossJoin(pages.df).mapInArrow(choose, "strip int, q_ids binary, q_dim int, q_cells binary, least binary")  # blocks of queries and of bounds
    rest = grid.join(strips.df, "strip").mapInArrow(score, _HITS)
    ranked = seeds.df.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
