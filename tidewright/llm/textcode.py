"""Words, shingles and windows of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import ctypes
import hashlib
import sys

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; bounds a Python worker's memory at about 20 times this.
CHUNK_BYTES = 4 << 20

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=U)
_GOLD = U(0x9E3779B97F4A7C15)
#: Words of more bytes than this are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))


class Words:
    """The words of a chunk of texts: buf holds the bytes; word i is buf[start[i]:end[i]]; text d has words first[d]:first[d + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        buf = raw[off[0] : off[-1]]
        off = off - off[0]
        self.buf = _LOWER[buf] if lower else buf
        inside = ~_SPACE[self.buf]
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = ~inside[:-1] | edge[1:n]
            after[:-1] = ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, off)
        self.texts = len(texts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes at a time."""
        size = self.end - self.start
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix(size.astype(U) + U(1))
        at, todo = self.start, np.arange(len(size))
        left = size
        while len(todo):
            part = eight[at] & _MASKS[np.minimum(left, 8)]
            out[todo] = mix(out[todo] * _GOLD ^ part)
            more = (left > 8) & (size[todo] <= _LONG)
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` successive words; position i is that of the run's first word."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, U)
    for k in range(size):
        out = out * _GOLD + words[k : k + n]
        out ^= out >> U(29)
    return mix(out)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Returns what Arrow and the C library keep for reuse to the system: a worker that waits for its next task shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of Arrow batches whose texts hold about `limit` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8).copy()
        del col
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        del batch
        give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def deltas(x: np.ndarray) -> bytes:
    """Rising integers as one-byte steps, with larger steps behind the mark 255."""
    d = np.diff(x, prepend=0)
    small = np.minimum(d, 255).astype(np.uint8)
    big = d[d >= 255].astype("<u4")
    return len(small).to_bytes(4, "little") + small.tobytes() + big.tobytes()


def undeltas(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    d = np.frombuffer(b, np.uint8, n, 4).astype(np.int64)
    big = d == 255
    if big.any():
        d[big] = np.frombuffer(b, "<u4", int(big.sum()), 4 + n)
    return np.cumsum(d)
