"""Exact deduplication by counting quotient filters and byte verification.

Each partition's 64-bit fingerprints go into counting quotient filters, one for each range of fingerprints: the first
bits after the range's (the quotient) name a run, the others (the remainder) are kept sorted inside it with their
counts, so a filter loses nothing. Run lengths, remainders and counts are shipped; the filters of one range meet in one
group and merge two by two, by their sorted remainders. Only rows whose fingerprint has a count above one are read again
and compared byte by byte, by grouping on the text itself (with a partial aggregation, so each partition sends a text
once however many copies it holds).

Defined cases: null text is empty; a null doc_id loses to any other; of rows that repeat the same doc_id and text one
stays; an empty table gives an empty result. Texts are equal when identical after A-Z are lower-cased.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Table, fresh, hinted, partitions

#: Bytes of written fingerprints whose filters merge in one group.
RANGE_BYTES = 64 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower())


def _small(x: np.ndarray) -> bytes:
    """Counts as one byte each, larger ones behind the mark 255."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def _unsmall(b: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    x = np.frombuffer(b, np.uint8, n, at).astype(np.int64)
    big = x == 255
    many = int(big.sum())
    x[big] = np.frombuffer(b, "<i8", many, at + n)
    return x, at + n + 8 * many


class CountingQuotientFilter:
    """Counts of 64-bit fingerprints whose first `prefix` bits are `range_`.

    The `bits` bits after the prefix are the quotient, the rest the remainder: run[q] remainders have quotient q; they
    are sorted, each with its count. No bit is dropped, so nothing is lost."""

    def __init__(self, prefix: int, range_: int, bits: int, run: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        self.prefix, self.range, self.bits, self.run, self.remainder, self.count = prefix, range_, bits, run, remainder, count

    @classmethod
    def of(cls, fingerprints: np.ndarray, prefix: int = 0, range_: int = 0) -> CountingQuotientFilter:
        """A filter of about one remainder per quotient."""
        f, count = np.unique(fingerprints, return_counts=True)
        bits = max(1, int(len(f)).bit_length() - 1)
        low = f & cls._mask(64 - prefix)
        shift = np.uint64(64 - prefix - bits)
        run = np.bincount((low >> shift).astype(np.int64), minlength=1 << bits)
        return cls(prefix, range_, bits, run, low & cls._mask(64 - prefix - bits), count.astype(np.int64))

    @staticmethod
    def _mask(bits: int) -> np.uint64:
        return np.uint64((1 << bits) - 1)

    def widened(self, bits: int) -> CountingQuotientFilter:
        """The same filter with more quotient bits: the remainders' first bits move into the quotient, and the order stays."""
        more = bits - self.bits
        if not more:
            return self
        left = np.uint64(64 - self.prefix - bits)
        quotient = (np.repeat(np.arange(len(self.run)), self.run) << more) + (self.remainder >> left).astype(np.int64)
        return CountingQuotientFilter(self.prefix, self.range, bits, np.bincount(quotient, minlength=1 << bits), self.remainder & self._mask(int(left)), self.count)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Runs of equal quotients are merged by their sorted remainders; counts of equal remainders add up."""
        a, b = (f.widened(max(self.bits, other.bits)) for f in (self, other))
        keys = []
        for f in (a, b):
            quotient = np.repeat(np.arange(len(f.run), dtype=np.uint64), f.run)
            keys.append((quotient << np.uint64(64 - f.prefix - f.bits)) | f.remainder)  # the order of (quotient, remainder)
        at = np.searchsorted(*keys)
        same = np.zeros(len(at), bool)
        inside = at < len(keys[0])
        same[inside] = keys[0][at[inside]] == keys[1][inside]
        count = a.count.copy()
        count[at[same]] += b.count[same]
        new = ~same
        quotient = np.repeat(np.arange(len(b.run)), b.run)[new]
        return CountingQuotientFilter(a.prefix, a.range, a.bits, a.run + np.bincount(quotient, minlength=len(a.run)), np.insert(a.remainder, at[new], b.remainder[new]), np.insert(count, at[new], b.count[new]))

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.run), dtype=np.uint64), self.run)
        low = (quotient << np.uint64(64 - self.prefix - self.bits)) | self.remainder
        return low | (np.uint64(self.range << (64 - self.prefix)) if self.prefix else np.uint64(0))

    def to_bytes(self) -> bytes:
        """Run lengths, remainders of as many bytes as they need, counts."""
        each = -(-(64 - self.prefix - self.bits) // 8)
        raw = self.remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :each]
        return bytes([self.prefix, self.bits]) + self.range.to_bytes(4, "little") + _small(self.run) + raw.tobytes() + _small(self.count)

    @classmethod
    def from_bytes(cls, b: bytes) -> CountingQuotientFilter:
        prefix, bits, range_ = b[0], b[1], int.from_bytes(b[2:6], "little")
        run, at = _unsmall(b, 6, 1 << bits)
        n, each = int(run.sum()), -(-(64 - prefix - bits) // 8)
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :each] = np.frombuffer(b, np.uint8, n * each, at).reshape(n, each)
        count, _ = _unsmall(b, at + n * each, n)
        return cls(prefix, range_, bits, run, raw.view("<u8").reshape(n), count)


def filters(fingerprints: np.ndarray, ranges_log2: int):
    """One filter for each range of fingerprints that holds something."""
    f = np.sort(fingerprints)
    edge = np.searchsorted(f >> np.uint64(64 - ranges_log2), np.arange((1 << ranges_log2) + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(edge)):
        yield CountingQuotientFilter.of(f[edge[r] : edge[r + 1]], ranges_log2, int(r))


def merged(found: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """All filters of a range, merged two by two."""
    while len(found) > 1:
        found = [a.merge(b) for a, b in zip(found[::2], found[1::2], strict=False)] + found[len(found) - len(found) % 2 :]
    return found[0]


def repeated_fingerprints(fingerprints: DataFrame, ranges_log2: int) -> DataFrame:
    """The values of the one column `fp` whose count is above one. Partitions ship filters, cut by range; a range's filters merge in one group."""

    def build(batches):
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if parts:
            found = [(f.range, f.to_bytes()) for f in filters(np.concatenate(parts).astype(np.int64).view(np.uint64), ranges_log2)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names=["range", "cut"])

    def repeated(table: pa.Table) -> pa.Table:
        f = merged([CountingQuotientFilter.from_bytes(c.as_py()) for c in table.column("cut")])
        return pa.table({"fp": pa.array(f.fingerprints()[f.count > 1].view(np.int64))})

    return fingerprints.select("fp").mapInArrow(build, "range int, cut binary").groupBy("range").applyInArrow(repeated, "fp long")


def verified_groups(docs: DataFrame, ranges_log2: int | None = None) -> tuple[Table, Table]:
    """(rows: row, doc_id, fp, sha), (groups of two rows or more: g_fp, g_sha, keep_id, group_size)."""
    spark = docs.sparkSession
    n = normalised()
    # `row` is written with the row, so it stays what it is
    rows = Table(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(n).alias("fp"), F.unhex(F.sha2(n, 256)).alias("sha")), "fingerprints")
    log2 = ranges_log2 if ranges_log2 is not None else max(1, (2 * partitions(spark) - 1).bit_length(), math.ceil(math.log2(max(1, rows.bytes) / RANGE_BYTES)))
    routed = Table(repeated_fingerprints(rows.df, log2).withColumnRenamed("fp", "g_fp"), "repeated")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    text = text.join(hinted(routed), F.col("fp") == F.col("g_fp"), "left_semi")
    same = text.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = Table(same.select(F.xxhash64("norm").alias("g_fp"), F.unhex(F.sha2("norm", 256)).alias("g_sha"), "keep_id", "group_size"), "groups")
    routed.drop()
    return rows, groups


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = verified_groups(docs)
    found = rows.df.join(hinted(groups), (F.col("sha") == F.col("g_sha")) & (F.col("fp") == F.col("g_fp")), "left")
    alone = F.col("group_size").isNull()
    stays = found.filter(~alone & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("row").alias("stays"))  # of rows that repeat a doc_id and text, one
    stays = Table(stays.select("stays"), "staying")
    out = found.join(hinted(stays), F.col("row") == F.col("stays"), "left")
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("stays").isNotNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    _, groups = verified_groups(docs)
    sha, g_fp, g_sha, keep, size = fresh(docs, "_sha", "_g_fp", "_g_sha", "_keep", "_size")
    known = docs.withColumn(sha, F.unhex(F.sha2(normalised(), 256)))
    found = known.join(hinted(groups).toDF(g_fp, g_sha, keep, size), F.col(sha) == F.col(g_sha), "left")
    several = F.col(size).isNotNull()
    staying = found.filter(several & F.col("doc_id").cast("long").eqNullSafe(F.col(keep))).dropDuplicates([sha])  # each partition sends one row a text
    return found.filter(~several).unionByName(staying).select(*[F.col(f"`{c}`") for c in docs.columns])
