"""Substring deduplication by level-wise doubling.

Lengths double up to the wanted window (13 words: 7, then 13). At each level the windows of that length that are still
candidates are hashed; those that stand in one document alone are dropped, and a window is a candidate of the next
level only if both its halves were found repeated. The last level decides: a window is removed if its words also start
in a document with a smaller doc_id.

A level is one exchange of packed rows. Texts are hashed a chunk at a time; a chunk first settles what it can by itself
(of a hash in several of its documents, only the smallest document's windows need an answer from outside, so a passage
that a third of all rows share is sent once per chunk), then sends the rest as packed hashes and positions, bucketed by
hash. A bucket answers with positions; answers meet by chunk and become one bitmap per document. Early levels send 32
bits besides the bucket's (a false match only makes a candidate), the last level 64: at 10^8 windows a false match has
odds of about 10^-5.

Defined cases: null text has no words; texts shorter than the window lose nothing; a null doc_id counts as larger than
any other; rows that repeat a doc_id and text are one document's rows and treated alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import released
from .runtime import Table, bucket_count, fixed, hinted
from .textcode import Words, chunks, column, deltas, mix, seeded, undeltas, windows

_SENT = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary"
_LAST = np.iinfo(np.int64).max
_ENTRIES, _HEADER, _ANSWER, _SHARED = 0, 1, 2, 3


def lengths(size: int, shortest: int = 7) -> list[int]:
    """The levels' window lengths: each twice the one before (the last one cut to `size`)."""
    found = [size]
    while (found[0] + 1) // 2 >= shortest:
        found.insert(0, (found[0] + 1) // 2)
    return found


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


def _rows(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, cols, strict=True)], schema=schema)


_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), *[(x, pa.binary()) for x in "abcd"]])


def _gaps(ids: np.ndarray) -> bytes:
    """Rising 64-bit integers as the first one and steps of as few bytes as the largest one takes."""
    steps = np.diff(ids.view(np.uint64))
    width = next(w for w in (1, 2, 4, 8) if int(steps.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + ids[:1].astype("<i8").tobytes() + steps.astype(f"<u{width}").tobytes()


def _ungaps(b: bytes) -> np.ndarray:
    steps = np.frombuffer(b, f"<u{b[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.r_[np.frombuffer(b, "<u8", 1, 1), steps], dtype=np.uint64).view(np.int64)


def _level(batches, size: int, before: int | None, last: bool, buckets: int, select=None, both: bool = False):
    """One level's rows of a partition. `select` (windows, which lie in one text) may retain some windows only. With `both` the last level also tells which windows another document has."""
    for chunk in chunks(batches, "text"):
        ids = column(chunk, "doc_id").fill_null(_LAST).to_numpy()
        if (ids[1:] < ids[:-1]).any():  # rising ids take few bytes
            rising = np.argsort(ids, kind="stable")
            chunk, ids = chunk.take(pa.array(rising)), ids[rising]
        w = Words(column(chunk, "text"))
        first = w.first
        win = windows(w.hashes(), size)
        doc = np.repeat(np.arange(w.texts), np.diff(first))[: len(win)]
        on = np.arange(len(win)) + size <= first[doc + 1]
        if before is not None:
            known = np.zeros(len(w), bool)
            for d, b in enumerate(column(chunk, "bits").to_pylist()):
                if b is not None:
                    n = first[d + 1] - first[d]
                    known[first[d] : first[d + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=n).view(bool)
            on &= known[: len(win)] & known[size - before :][: len(win)]
        if select is not None:
            on &= select(win, on)
        at = np.flatnonzero(on)
        if not len(at):
            continue
        texts = column(chunk, "h").to_numpy()
        h, order = win[at], ids[doc[at]]
        by = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
        low, high = np.minimum.reduceat(order[by], edge), np.maximum.reduceat(order[by], edge)
        many = np.diff(np.r_[edge, len(by)])
        least, several = np.empty(len(at), np.int64), np.empty(len(at), bool)
        least[by], several[by] = np.repeat(low, many), np.repeat(low != high, many)
        settled = order > least if last else several
        local = np.zeros(len(w), bool)
        local[at[settled]] = True
        shared = np.zeros(len(w), bool)
        shared[at[several]] = True
        send = np.flatnonzero(order == least)
        h, at, order, several = h[send], at[send], order[send], several[send]
        bucket = (seeded(h, 7) % np.uint64(buckets)).astype(np.int64)
        split = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[split], np.arange(buckets + 1))
        name = int(np.bitwise_xor.reduce(mix(texts.view(np.uint64) + np.arange(len(texts), dtype=np.uint64))) ^ mix(ids.view(np.uint64)).sum(dtype=np.uint64)) % (1 << 63)
        rows = [(name % buckets, name, _HEADER, ids.astype("<i8").tobytes() + texts.astype("<i8").tobytes() + np.asarray(column(chunk, "doc_id").is_null()).astype(np.uint8).tobytes(), first.astype("<i8").tobytes(), np.packbits(local).tobytes(), np.packbits(shared).tobytes() if both else None)]
        for b in np.flatnonzero(np.diff(edges)):
            own = split[edges[b] : edges[b + 1]]
            docs_, place = np.unique(doc[at[own]], return_inverse=True)
            bits = h[own].astype("<u8") if last else (h[own] >> np.uint64(32)).astype("<u4")
            # a document's number in the chunk follows from the position, so only the documents' order values are sent
            rows.append((int(b), name, _ENTRIES, bits.tobytes(), deltas(at[own]), _gaps(ids[docs_]), deltas(place) + np.packbits(several[own]).tobytes()))
        yield _rows(rows, _SENT_ARROW.names, _SENT_ARROW)


def _answers(table: pa.Table, last: bool, both: bool = False) -> pa.Table:
    kinds = np.asarray(table.column("kind"))
    kept = table.filter(pa.array(kinds == _HEADER))
    table = table.filter(pa.array(kinds == _ENTRIES))
    names, at, order, several, bits = table.column("chunk").to_pylist(), [], [], [], []
    for a, b, c, d in zip(*(table.column(x).to_pylist() for x in "abcd"), strict=True):
        bits.append(np.frombuffer(a, "<u8" if last else "<u4"))
        at.append(undeltas(b))
        place = undeltas(d)
        order.append(_ungaps(c)[place])
        several.append(np.unpackbits(np.frombuffer(d[-(-(-len(place) // 8)) :], np.uint8), count=len(place)).view(bool))
    rows: list[tuple] = []
    if names:
        sizes = [len(x) for x in at]
        h, order, several = np.concatenate(bits), np.concatenate(order), np.concatenate(several)
        by = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
        low, high = np.minimum.reduceat(order[by], edge), np.maximum.reduceat(order[by], edge)
        yes = np.empty(len(h), bool)
        many = np.diff(np.r_[edge, len(by)])
        # rows of one document may meet in several chunks, of which some know more of its hash than others
        shared = np.repeat((low != high) | np.logical_or.reduceat(several[by], edge), many) & ~several[by]
        yes[by] = order[by] > np.repeat(low, many) if last else shared
        found = [(_ANSWER, yes)]
        if both:
            also = np.empty(len(h), bool)
            also[by] = shared
            found.append((_SHARED, also))
        for kind, marks in found:
            for name, x, y in zip(names, at, np.split(marks, np.cumsum(sizes)[:-1]), strict=True):
                if y.any():
                    rows.append((0, name, kind, deltas(x[y]), None, None, None))
    return pa.concat_tables([kept.select(_SENT_ARROW.names).cast(_SENT_ARROW), pa.Table.from_batches([_rows(rows, _SENT_ARROW.names, _SENT_ARROW)])])


_BITS = pa.schema([("b_id", pa.int64()), ("b_h", pa.int64()), ("bits", pa.binary())])
_BOTH = _BITS.append(pa.field("shared", pa.binary()))


def _bitmaps(table: pa.Table, both: bool = False) -> pa.Table:
    kinds = np.asarray(table.column("kind"))
    head = table.filter(pa.array(kinds == _HEADER)).to_pylist()[0]
    first = np.frombuffer(head["b"], "<i8")
    n = len(first) - 1
    ids, texts, null = np.frombuffer(head["a"], "<i8", n), np.frombuffer(head["a"], "<i8", n, 8 * n), np.frombuffer(head["a"], np.uint8, n, 16 * n)
    marks = []
    for field, kind in (("c", _ANSWER), ("d", _SHARED))[: 1 + both]:
        found = np.unpackbits(np.frombuffer(head[field], np.uint8), count=first[-1]).view(bool)
        for a in table.filter(pa.array(kinds == kind)).column("a").to_pylist():
            found[undeltas(a)] = True
        marks.append(found)
    rows = []
    for d in np.unique(np.searchsorted(first, np.flatnonzero(np.logical_or.reduce(marks)), "right") - 1):
        rows.append((None if null[d] else int(ids[d]), int(texts[d]), *(np.packbits(m[first[d] : first[d + 1]]).tobytes() for m in marks)))
    schema = _BOTH if both else _BITS
    return pa.Table.from_batches([_rows(rows, schema.names, schema)])


def repeated_windows(docs: DataFrame, size: int = 13, broadcast_bytes: int | None = None) -> Table:
    """b_id, b_h (doc_id and text hash) and bits: bit i says that the window starting at word i also starts in a document with a smaller doc_id."""
    texts = keyed(docs)
    buckets = bucket_count(docs)
    before, found = None, None
    levels = lengths(size)
    for n in levels:
        last = n == levels[-1]
        source = texts if found is None else with_bits(texts, found, "inner", broadcast_bytes)
        sent = source.mapInArrow(fixed(_level, n, before, last, buckets), _SENT)
        answered = sent.groupBy("bucket").applyInArrow(fixed(_answers, last), _SENT)
        maps = answered.groupBy("chunk").applyInArrow(fixed(_bitmaps), "b_id long, b_h long, bits binary")
        table = Table(maps.dropDuplicates(["b_id", "b_h"]), f"windows-{n}")
        if found is not None:
            found.drop()
        found, before = table, n
        del source, sent, answered, maps
        released(docs.sparkSession)  # a level's exchange needn't stay for the next one's
    return found


def with_bits(texts: DataFrame, found: Table, how: str, broadcast_bytes: int | None = None) -> DataFrame:
    bits = hinted(found) if broadcast_bytes is None else hinted(found, broadcast_bytes)
    return texts.join(bits, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h")), how).select("doc_id", "h", "text", "bits")


def covered(bits: bytes | None, n_words: int, size: int) -> np.ndarray:
    """Which words a marked window covers."""
    if bits is None:
        return np.zeros(n_words, bool)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n_words))
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + size, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def deduplicated(docs: DataFrame, size: int = 13, digest: bool = False, broadcast_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (kept words joined by one space), or with `digest` its SHA-256."""
    found = repeated_windows(docs, size, broadcast_bytes)
    kind = "kept_sha256" if digest else "kept_text"

    def cut(batches):
        for chunk in chunks(batches, "text"):
            words, removed, kept = [], [], []
            for text, bits in zip(column(chunk, "text").to_pylist(), column(chunk, "bits").to_pylist(), strict=True):
                w = (text or "").encode().split()
                gone = covered(bits, len(w), size)
                left = b" ".join(w if bits is None else [x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                words.append(len(w))
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", kind])

    return with_bits(keyed(docs), found, "left", broadcast_bytes).mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {kind} string")
