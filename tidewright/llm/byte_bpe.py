"""Byte-level BPE encoding and decoding in numpy.

A text is split by the vocabulary's pattern. The distinct splits of a chunk of texts are bucketed by length into padded
matrices of byte ids, one row each. In every round each row finds its adjacent pair of least rank (the leftmost, where
several have it) in a hash table of pairs, merges it, and the rows are compacted; rows without a pair are done. Splits
over `LONG` bytes would make wide matrices with as many rounds as bytes, so they use a heap of pairs instead, which
merges in the same order.

Defined cases: null text is empty and has no ids; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcode import chunks, column, mix

#: Splits of more bytes are merged by heap.
LONG = 128
#: Up to so many bytes a bucket holds one length and needs no padding.
EXACT = 24
#: Bytes of text whose splits are merged together.
CHUNK = 3 << 20
#: Splits whose ids a worker remembers between chunks.
REMEMBERED = 300_000
_NONE = np.int32(2**31 - 1)


class ByteBPE:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes[i] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(self.ranks[t[:k]], self.ranks[t[k:]]): i for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self._table()
        self.known: dict[str, list[int]] = {}

    def _table(self) -> None:
        """Open addressing with linear probing; slots hold the pair as one integer, and its rank, which is the merged id."""
        self.mask = (1 << (2 * len(self.pairs)).bit_length()) - 1
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        ids = np.array(list(self.pairs.values()), np.int32)
        self.slot_key, self.slot_id = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            empty = self.slot_key[at[left]] < 0
            self.slot_key[at[left[empty]]] = keys[left[empty]]  # of several, the last written has the slot
            won = self.slot_key[at[left]] == keys[left]
            self.slot_id[at[left[won]]] = ids[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the largest integer; a negative id pairs with nothing."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        flat = np.full(keys.size, _NONE, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys, shape = keys.ravel()[todo], keys.shape
        at = self._slot(keys)
        while len(todo):
            got = self.slot_key[at]
            hit = got == keys
            flat[todo[hit]] = self.slot_id[at[hit]]
            on = ~hit & (got >= 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return flat.reshape(shape)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Rows of byte ids padded with -1, merged until no pair has a rank; padded with -1."""
        done = np.full(rows.shape, -1, np.int32)
        live = np.arange(len(rows))
        ranks = self.rank(rows[:, :-1], rows[:, 1:])
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NONE)
            over = best == _NONE
            if over.any():
                done[live[over], : rows.shape[1]] = rows[over]
                live, rows, ranks, at, best = live[~over], rows[~over], ranks[~over], at[~over], best[~over]
            if not len(rows):
                return done
            here = np.arange(len(rows))
            col = np.arange(rows.shape[1] - 1)
            rows[here, at] = best
            shift = col >= at[:, None] + 1
            rows = np.where(shift, rows[:, 1:], rows[:, :-1])  # the merged pair's right part goes
            ranks = np.where(col[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1]) if rows.shape[1] > 1 else ranks[:, :0]
            if rows.shape[1] > 1:
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < rows.shape[1] - 1)
                    ranks[here[ok], side[ok]] = self.rank(rows[here[ok], side[ok]], rows[here[ok], side[ok] + 1])
            width = int((rows >= 0).sum(1).max())
            rows, ranks = rows[:, :width], ranks[:, : max(0, width - 1)]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap: least rank first, then leftmost."""
        ids = [int(self.byte_id[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def learn(self, splits: list[str]) -> None:
        """Puts the ids of new splits into `known`."""
        buckets: dict[int, tuple[list[str], list[bytes]]] = {}
        whole, known = self.ranks.get, self.known
        for s, b in zip(splits, [s.encode() for s in splits], strict=True):
            if (rank := whole(b)) is not None:
                known[s] = [rank]
            elif (n := len(b)) > LONG:
                known[s] = self.merge_long(b)
            else:
                names, raw = buckets.setdefault(n if n <= EXACT else 1 << (n - 1).bit_length(), ([], []))
                names.append(s)
                raw.append(b)
        for width, (names, raw) in buckets.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(names), step):
                part = raw[k : k + step]
                if width > EXACT:
                    cells = np.frombuffer(b"".join([b.ljust(width, b"\0") for b in part]), np.uint8).reshape(-1, width)
                    ids = np.where(np.arange(width) < np.fromiter(map(len, part), np.int64, len(part))[:, None], self.byte_id[cells], -1).astype(np.int32)
                else:
                    ids = self.byte_id[np.frombuffer(b"".join(part), np.uint8).reshape(-1, width)]
                merged = self.merge_rows(ids)
                there = merged >= 0
                flat, at = merged[there].tolist(), 0
                for s, end in zip(names[k : k + step], np.cumsum(there.sum(1)).tolist(), strict=True):
                    known[s] = flat[at:end]
                    at = end

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(chain.from_iterable(split)).difference(self.known)
        self.learn(list(new))
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


_coders: dict = {}


def coder(ranks_path: str, pattern: str) -> ByteBPE:
    if ranks_path not in _coders:
        _coders[ranks_path] = ByteBPE(ranks_path, pattern)
    return _coders[ranks_path]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every text, decoded (binary) from those ids; with `digest`, n_tokens and the
    SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes instead."""

    def run(batches):
        bpe = coder(ranks_path, pattern)
        decimal = [str(i) for i in range(len(bpe.bytes))]
        for chunk in chunks(batches, "text", CHUNK):
            ids = bpe.encode_batch([t or "" for t in column(chunk, "text").to_pylist()])
            out = {"doc_id": column(chunk, "doc_id")}
            if digest:
                out["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
                out["ids_sha256"] = pa.array([hashlib.sha256(",".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids])
                out["decoded_sha256"] = pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])
            else:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
                out["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
