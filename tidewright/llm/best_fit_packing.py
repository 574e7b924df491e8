"""Best-fit packing of token sequences, bulk-synchronous.

Documents become pieces of at most `capacity` tokens. Pieces of more than half a sequence open one each. The others are
placed by rounds, longest size class first. A round range-sorts its pieces and the open gaps together by size, largest
first; a sweep of a partition keeps its gaps on a stack, so the top is the successor of the piece that comes next: the
smallest gap that still holds it. What a partition can't match by itself is matched across partitions by rank: from two
numbers a partition (pieces left, gaps left) follows which ranks of which partitions meet, and an equi-join on
(partition, rank) brings them together. Gaps shrink, and the class repeats while a round places a tenth of its pieces;
then the pieces that no gap took open sequences, as many to one as fit. A gap may take several pieces of a class in one round (as many
as its largest ones would allow), so rounds don't grow with the data: they follow from the classes.

A piece is written a few times as (number, length) and looked up once. The driver sees two numbers a partition and a
count for each length. Equal lengths are spread over partitions by the pieces' numbers, new sequences over salted groups.

Defined cases: null text is empty, an empty text is the closing id alone; a null doc_id is kept as null; repeated rows
are packed separately; ties between equal sizes go by number; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Table, fixed, in_small_batches
from .textcode import give_back

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict = {}


def encoder(ranks_path: str, pattern: str):
    """A byte-level BPE encoder from a file of ranks, made once per Python worker."""
    if ranks_path not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int, closing_id: int) -> DataFrame:
    """One row per piece. Only documents longer than the capacity are cut; their first piece takes the remainder."""

    def cut(batches):
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            rows: list = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.encode_to_numpy(text.as_py() or ""), closing_id).astype("<u4")
                n = len(ids)
                head = n % capacity or min(n, capacity)
                at = 0
                for k, end in enumerate(range(head, n + 1, capacity)):
                    rows.append((doc_id, k, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at = end
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            del batch, rows, cols
            give_back()

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).mapInArrow(cut, PIECES)


_SWEPT = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("units", pa.int64())])
_SWEPT_SQL = "kind int, id long, length long, seq long, part int, at long, units long"
_PLACED, _PIECE, _GAP = 0, 1, 2
#: Lengths up to this are one class.
SMALL = 8


def sweep(batches, part: int | None = None):
    """Matches the sorted sizes of a partition (columns size, is_piece, id, units): each piece takes a unit of the last gap that has one.

    Rows out: pieces placed; pieces left, with their rank `at`; gaps left, with the rank of their first unit."""
    if part is None:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
    stack: list[list[int]] = []
    left = 0
    for batch in batches:
        rows = []
        for size, is_piece, i, units in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if not is_piece:
                stack.append([i, units])
            elif stack:
                top = stack[-1]
                rows.append((_PLACED, i, size, top[0], None, None, None))
                top[1] -= 1
                if not top[1]:
                    stack.pop()
            else:
                rows.append((_PIECE, i, size, None, part, left, None))
                left += 1
        if rows:
            yield _swept(rows)
    at = 0
    for k in range(0, len(stack), 10_000):
        rows = []
        for seq, units in stack[k : k + 10_000]:
            rows.append((_GAP, None, None, seq, part, at, units))
            at += units
        yield _swept(rows)


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SWEPT.types, strict=True)], schema=_SWEPT)


def meetings(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """left[part] = (pieces, units of gaps) that a sweep left. Rows (part, first rank, pieces, part of the gaps, end): the piece of rank first + i takes the unit of rank end - 1 - i."""
    stack: list[list[int]] = []
    out = []
    for part in sorted(left):
        pieces_, units = left[part]
        rank = 0
        while rank < pieces_ and stack:
            of, free = stack[-1]
            n = min(free, pieces_ - rank)
            out.append((part, rank, n, of, free))
            rank += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if units:
            stack.append([part, units])
    return out


def classes(capacity: int) -> list[tuple[int, int]]:
    """(lowest, highest) length of each class, longest first, of pieces of up to half a sequence."""
    found, high = [], capacity // 2
    while high > 0:
        low = high // 2 + 1 if high > SMALL else 1
        found.append((low, high))
        high = low - 1
    return found


class Packer:
    """The rounds. items: pid, length. `placed` has frames of pid, length, sequence_id; `rounds` counts sweeps."""

    def __init__(self, items: DataFrame, capacity: int, rows_per_salt: int = 100_000, rows_per_sweep: int = 200_000):
        self.spark, self.items, self.capacity, self.rows_per_salt, self.rows_per_sweep = items.sparkSession, items, capacity, rows_per_salt, rows_per_sweep
        self.placed: list[DataFrame] = []
        self.rounds = self.openings = self.done = 0
        self.open: Table | None = None

    def run(self) -> DataFrame:
        """pid, sequence_id of every item."""
        counts = {r[0]: r[1] for r in self.items.groupBy("length").count().collect()}  # one number per length
        half = self.capacity // 2
        self._opened(self.items.filter(F.col("length") > half).withColumn("sequence_id", -F.col("pid") - 1))
        self.done = sum(n for length, n in counts.items() if length > half)
        for low, high in classes(self.capacity):
            if many := sum(n for length, n in counts.items() if low <= length <= high):
                self._place(self.items.filter(F.col("length").between(low, high)), many, low, high)
        return reduce(DataFrame.unionByName, self.placed).select("pid", "sequence_id")

    def _opened(self, rows: DataFrame) -> None:
        """Places rows (pid, length, sequence_id) in new sequences."""
        t = Table(rows.select("pid", "length", "sequence_id"), "packed")
        self.placed.append(t.df)
        gaps = t.df.groupBy("sequence_id").agg((F.lit(self.capacity) - F.sum("length")).alias("gap")).filter("gap > 0")
        before, self.open = self.open, Table(gaps if self.open is None else self.open.df.unionByName(gaps), "gaps")
        if before is not None:
            before.drop()

    def _place(self, left: DataFrame, many: int, low: int, high: int) -> None:
        """Sweeps while a sweep places a tenth of its pieces or more; what is left opens sequences."""
        while many:
            swept, segments, rest = self._sweep(left, many, low, high)
            pieces_ = swept.df.filter(F.col("kind") == _PIECE).select("id", "length", "part", "at")
            seg = F.broadcast(self.spark.createDataFrame(segments, "p int, first long, n long, of int, end long"))  # a few rows a partition
            meets = pieces_.join(seg, (F.col("part") == F.col("p")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n")), "left")
            meets = meets.withColumn("unit", F.col("end") - 1 - (F.col("at") - F.col("first")))
            now = swept.df.filter(F.col("kind") == _PLACED).select(F.col("id").alias("pid"), "length", F.col("seq").alias("sequence_id"))
            if segments:
                gaps = swept.df.filter(F.col("kind") == _GAP).select("seq", F.col("part").alias("g_part"), F.col("at").alias("g_at"), "units")
                used = gaps.join(seg, (F.col("g_part") == F.col("of")) & (F.col("g_at") < F.col("end")) & (F.col("g_at") + F.col("units") > F.col("end") - F.col("n")))
                used = used.select("g_part", "seq", F.explode(F.sequence(F.greatest("g_at", F.col("end") - F.col("n")), F.least(F.col("g_at") + F.col("units"), "end") - 1)).alias("g_unit"))
                across = meets.filter("unit IS NOT NULL").join(used, (F.col("of") == F.col("g_part")) & (F.col("unit") == F.col("g_unit")))
                now = now.unionByName(Table(across.select(F.col("id").alias("pid"), "length", F.col("seq").alias("sequence_id")), "packed").df)
            if rest < many:
                self.placed.append(now)
                taken = now.groupBy("sequence_id").agg(F.sum("length").alias("taken"))
                before, self.open = self.open, Table(self.open.df.join(taken, "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).filter("gap > 0"), "gaps")
                before.drop()
            self.done += many - rest
            left = meets.filter("unit IS NULL").select(F.col("id").alias("pid"), "length")
            if rest and 10 * (many - rest) < many:
                self._open_for(left, rest)
                break
            many = rest

    def _sweep(self, left: DataFrame, many: int, low: int, high: int) -> tuple[Table, list[tuple], int]:
        """(the sweep's rows, which ranks meet across partitions, how many pieces stay unplaced)."""
        self.rounds += 1
        wanted = left.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), F.col("pid").alias("id"), F.lit(1).cast("long").alias("units"))
        gaps = self.open.df.filter(F.col("gap") >= low).select(F.col("gap").alias("size"), F.lit(False).alias("is_piece"), F.col("sequence_id").alias("id"), F.greatest(F.lit(1), F.floor(F.col("gap") / high)).cast("long").alias("units"))
        order = (F.desc("size"), F.asc("is_piece"), F.asc("id"))
        parts = max(1, math.ceil((many + self.done) / self.rows_per_sweep))  # there are no more open sequences than pieces placed
        both = wanted.unionByName(gaps).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        swept = Table(both.mapInArrow(fixed(sweep), _SWEPT_SQL), "swept")
        ends = swept.df.filter(F.col("kind") != _PLACED).groupBy("part").agg(F.count(F.when(F.col("kind") == _PIECE, 1)).alias("pieces"), F.coalesce(F.sum("units"), F.lit(0)).alias("units")).collect()
        segments = meetings({r[0]: (r[1], r[2]) for r in ends})
        return swept, segments, sum(r[1] for r in ends) - sum(s[2] for s in segments)

    def _open_for(self, rows: DataFrame, count: int) -> None:
        """Opens sequences, with as many pieces of about one length each as fit."""
        self.openings += 1
        salts = max(1, math.ceil(count / self.rows_per_salt))
        each = rows.withColumn("each", F.floor(F.lit(self.capacity) / F.col("length"))).withColumn("salt", F.pmod(F.xxhash64("pid"), F.lit(salts)))
        nth = F.row_number().over(Window.partitionBy("each", "salt").orderBy(F.desc("length"), "pid")) - 1
        ids = F.lit(self.openings << 56).cast("long") + F.col("each") * (1 << 44) + F.col("salt") * (1 << 24) + F.floor(nth / F.col("each"))
        self._opened(each.withColumn("sequence_id", ids.cast("long")))


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, closing_id: int = 2, rows_per_salt: int = 100_000) -> DataFrame:
    """Columns of `pieces` and sequence_id, offset. The tokenised pieces are written to the shared folder first."""
    table = Table(pieces(docs, ranks_path, pattern, capacity, closing_id).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    found = Packer(table.df.select("pid", "length"), capacity, rows_per_salt).run()
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    return table.df.join(found, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
