"""Suffix-array deduplication with sparse suffix arrays.

Of each text only the suffixes that start at minimisers are retained: of every `span` successive word k-grams the one
with the least hash, so two texts that share k + span - 1 words in a row retain a common place inside them. Retained
places whose k-gram stands in one document alone are dropped (one exchange of packed hashes). The others are sorted by
the words that follow, as a suffix array is; each is compared with its nearest neighbours on both sides, and with the
nearest neighbours of smaller doc_id, and the match is extended to the left by the words before the place. A second
pass does the same with the words before as the sort key. A match of `size` words or more is a repeated span; the
document with the larger doc_id loses it, so of every removed word a copy stays in a smaller document.

Neither order ranks by the total match, so the neighbours may miss a span. A third step decides exactly: every window of
`size` words whose minimisers all stand in other documents too is hashed, and one packed exchange gives the smallest
doc_id that has it. Equal windows have equal minimisers, so no repeated window lacks its place in that exchange.

A place carries its next `size` and last size - k words as 32-bit hashes, enough to decide a match of `size` words;
longer passages are covered by their successive places. The sort is by range over words, doc_id and position, so a
passage that a third of all rows share is spread over partitions. Neighbours across the edge of two partitions are left
to the third step, so the result doesn't depend on the partitions.

Defined cases: null text has no words; texts shorter than `size` words have no spans; rows without a doc_id count as
larger than any other; repeated rows are one document; repeats inside one document don't count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Table, bucket_count, fixed, hinted
from .substring_dedup import _SENT, _answers, _bitmaps, _level, keyed, with_bits
from .textcode import Words, chunks, column, windows

K_GRAM, SPAN = 10, 31
_PLACES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("after", pa.binary()), ("before", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])
_FOUND_SQL = "doc_id long, h long, start int, end int, removed boolean"


def _least(grams: np.ndarray, inside: np.ndarray, span: int):
    """In steps: the first of some `span` successive k-grams, the place of the least of each, and which lie in one text."""
    if len(grams) < span:
        return
    value = np.where(inside, grams, np.uint64(2**64 - 1))
    view = np.lib.stride_tricks.sliding_window_view(value, span)
    ok = np.lib.stride_tricks.sliding_window_view(inside, span)
    step = 1 << 18
    for i in range(0, len(view), step):
        yield i, view[i : i + step].argmin(1) + np.arange(i, min(i + step, len(view))), ok[i : i + step].all(1)


def minimisers(grams: np.ndarray, inside: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which k-grams are the least of some `span` successive ones that lie in one text."""
    chosen = np.zeros(len(grams), bool)
    for _, at, whole in _least(grams, inside, span):
        chosen[at[whole]] = True
    return chosen


_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("text", pa.string()), ("bits", pa.binary())])


def _candidates(batches, size: int, k: int, span: int):
    """The texts with a bitmap of the windows of `size` words whose minimisers are all marked in `bits`."""
    for chunk in chunks(batches, "text"):
        w = Words(column(chunk, "text"))
        first = w.first
        grams = windows(w.hashes(), k)
        doc = np.repeat(np.arange(w.texts), np.diff(first))[: len(grams)]
        inside = np.arange(len(grams)) + k <= first[doc + 1]
        known = np.zeros(len(w), bool)
        for d, b in enumerate(column(chunk, "bits").to_pylist()):
            known[first[d] : first[d + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=first[d + 1] - first[d]).view(bool)
        bad = np.ones(len(w), bool)
        for i, at, whole in _least(grams, inside, span):
            bad[i : i + len(at)] = ~(whole & known[at])
        sums = np.concatenate([[0], np.cumsum(bad)])
        n = size - k - span + 2
        on = np.zeros(len(w), bool)
        on[: max(0, len(w) - n + 1)] = sums[n:] == sums[: max(0, len(sums) - n)]
        bits = [np.packbits(on[a:b]).tobytes() if on[a:b].any() else None for a, b in zip(first[:-1], first[1:], strict=True)]
        rows = chunk.select(["doc_id", "h", "text"]).append_column("bits", pa.array(bits, pa.binary()))
        yield rows.filter(pa.array([b is not None for b in bits])).cast(_CANDIDATES)


_SPANS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])


def _runs(table: pa.Table, size: int) -> pa.Table:
    """The spans that a chunk's marked windows cover."""
    maps, rows = _bitmaps(table, True), []
    for doc, h, *marks in zip(*(maps.column(c).to_pylist() for c in ("b_id", "b_h", "shared", "bits")), strict=True):
        for gone, bits in enumerate(marks):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
            if len(at):
                new = np.flatnonzero(np.diff(at) > size)
                rows += [(doc, h, a, b + size, bool(gone)) for a, b in zip(at[np.r_[0, new + 1]].tolist(), at[np.r_[new, len(at) - 1]].tolist(), strict=True)]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _SPANS.types, strict=True)], schema=_SPANS)


def _places(batches, size: int, k: int):
    for chunk in chunks(batches, "text", 1 << 20):  # a place's row takes far more memory than its words
        w = Words(column(chunk, "text"))
        short = (w.hashes() >> np.uint64(32)).astype(">u4")
        ids, texts, rows = column(chunk, "doc_id").to_pylist(), column(chunk, "h").to_pylist(), []
        for d, bits in enumerate(column(chunk, "bits").to_pylist()):
            a, b = int(w.first[d]), int(w.first[d + 1])
            own = short[a:b]
            back = own[::-1].tobytes()
            forth = own.tobytes()
            n = b - a
            for p in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n)).tolist():
                rows.append((ids[d], texts[d], p, forth[4 * p : 4 * (p + size)], back[4 * (n - p) : 4 * (n - p + size - k)]))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PLACES.types, strict=True)], schema=_PLACES)


def common(a: bytes, b: bytes) -> int:
    """Words that two hashed sequences have in common from the start."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    return int((np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n)).argmax())


def match(a: tuple, b: tuple, size: int) -> tuple[int, int] | None:
    """(words before, words after) of a match between two places, if it is long enough."""
    after, before = common(a[3], b[3]), common(a[4], b[4])
    return (before, after) if before + after >= size else None


_BIG = np.iinfo(np.int64).max


def _order(doc: int | None) -> int:
    return _BIG if doc is None else doc


def spans(a: tuple, b: tuple, size: int):
    """The spans that a match of two places makes: (place, start, end, removed)."""
    if a[0] == b[0] or (m := match(a, b, size)) is None:
        return
    for x, y in ((a, b), (b, a)):
        yield x, x[2] - m[0], x[2] + m[1], _order(x[0]) > _order(y[0])


def _neighbours(batches, size: int):
    """The spans that the sorted places of a partition make with their neighbours: the one before, and the nearest of smaller doc_id on both sides."""
    last = None
    stack: list[tuple] = []  # places whose next smaller doc_id hasn't come yet
    for batch in batches:
        out: dict[tuple, list[int]] = {}  # a place's spans all hold the place, so together they are one
        for x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            near = [last] if last is not None else []
            while stack and _order(stack[-1][0]) >= _order(x[0]):
                near.append(stack.pop())
            if stack:
                near.append(stack[-1])
            if not stack or stack[-1][3:] != x[3:]:  # of equal surroundings the smallest doc_id serves all that follow
                stack.append(x)
            for y in {id(y): y for y in near}.values():
                for p, a, b, gone in spans(x, y, size):
                    for kind in (False, True)[: 1 + gone]:
                        ends = out.setdefault((*p[:3], kind), [a, b])
                        ends[:] = min(a, ends[0]), max(b, ends[1])
            last = x
        if out:
            yield _batch([(p[0], p[1], a, b, p[3]) for p, (a, b) in out.items()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND.types, strict=True)], schema=_FOUND)


def repeated_spans(docs: DataFrame, size: int = 50, k: int = K_GRAM, span: int = SPAN) -> Table:
    """s_id, s_h (doc_id and text hash) and spans, in words: an array of (start, end, removed), first all repeated spans, then those removed; each kind sorted and united."""
    if k + span - 1 > size:
        raise ValueError("a passage of `size` words would need no minimiser")
    texts = keyed(docs)
    buckets = bucket_count(docs)
    sent = texts.mapInArrow(fixed(_level, k, None, False, buckets, lambda g, ok: minimisers(g, ok, span)), _SENT)
    maps = sent.groupBy("bucket").applyInArrow(fixed(_answers, False), _SENT).groupBy("chunk").applyInArrow(fixed(_bitmaps), "b_id long, b_h long, bits binary")
    shared = Table(maps.dropDuplicates(["b_id", "b_h"]), "minimisers")
    places = Table(with_bits(texts, shared, "inner").mapInArrow(fixed(_places, size, k), "doc_id long, h long, pos int, after binary, before binary"), "places")
    found = []
    for key in (("after", "before"), ("before", "after")):
        by = places.df.repartitionByRange(*key, "doc_id", "pos").sortWithinPartitions(*key, "doc_id", "pos")
        found.append(Table(by.mapInArrow(fixed(_neighbours, size), _FOUND_SQL), "neighbours").df)
    places.drop()
    # decide exactly: every window that may be repeated meets its equals
    sent = with_bits(texts, shared, "inner").mapInArrow(lambda batches: _level(_candidates(batches, size, k, span), size, size, True, buckets, both=True), _SENT)
    answered = sent.groupBy("bucket").applyInArrow(fixed(_answers, True, True), _SENT)
    found.append(answered.groupBy("chunk").applyInArrow(fixed(_runs, size), "doc_id long, h long, start int, end int, removed boolean"))
    every = reduce(DataFrame.unionByName, found)
    key = ("doc_id", "h", "removed", "start")
    out = Table(every.repartition("doc_id", "h").sortWithinPartitions(*key).mapInArrow(_united, "s_id long, s_h long, spans array<struct<start:int,end:int,removed:boolean>>"), "repeats")
    shared.drop()
    return out


_UNITED = pa.schema([("s_id", pa.int64()), ("s_h", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])))])


def _united(batches):
    """Unites the sorted spans of each text: those of all matches, and those that are removed."""
    now, own = None, []

    def made(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _UNITED.types, strict=True)], schema=_UNITED)

    for b in batches:
        rows = []
        for doc, h, start, end, gone in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if now != (doc, h):
                if now is not None:
                    rows.append((*now, own))
                now, own = (doc, h), []
            if own and own[-1]["removed"] == gone and start <= own[-1]["end"]:
                own[-1]["end"] = max(own[-1]["end"], end)
            else:
                own.append({"start": start, "end": end, "removed": gone})
        yield made(rows)
    if now is not None:
        yield made([(*now, own)])


def deduplicated(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_repeated, n_removed, repeated (spans start:end in words, joined by commas) and kept_text."""
    found = repeated_spans(docs, size)

    def cut(batches):
        for chunk in chunks(batches, "text"):
            rows = []
            for doc, text, marks in zip(*(column(chunk, c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                w = (text or "").encode().split()
                every, gone = ([(m["start"], m["end"]) for m in marks or () if m["removed"] == kind] for kind in (False, True))
                kept, at = [], 0
                for a, b in gone:
                    kept += w[at:a]
                    at = b
                kept += w[at:]
                rows.append((doc, len(w), sum(b - a for a, b in every), len(w) - len(kept), ",".join(f"{a}:{b}" for a, b in every), b" ".join(kept).decode()))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_repeated", "n_removed", "repeated", "kept_text"])

    d = keyed(docs)
    marked = d.join(hinted(found), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(cut, "doc_id long, n_words long, n_repeated long, n_removed long, repeated string, kept_text string")
