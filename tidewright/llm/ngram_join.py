"""Near-duplicate join on the Jaccard similarity of word n-gram sets, by parity sketches.

A set's tokens are dealt by hash into P parts, and in each part every token flips one bit of a wide bit sketch. Sketches
differ in at most as many bits as the sets differ in tokens, and a linked pair of a size band differs in at most T
tokens, so of P > T parts at least P - T are equal in both. Parts are joined by a 64-bit hash of their odd bits
(pigeonhole). P is about 1.25 T; a document leaves out parts of fewer than c tokens, with the largest c that leaves out
fewer than P - T parts, so an equal part that both send always remains and no link is lost. A set is sent in its own
size band and in those that its partners of larger size may lie in.

Equal sets are one class from the start, named by a 64-bit hash of the set. Classes that share a part form a list. In a
list, folded sketches of about a bit per token (whose Hamming distance also bounds the difference from below) rule out
pairs; the rest joins its classes to families, and only the sets of classes in families are read again. In a family,
longer sketches rule out pairs of different components, the others are verified on the exact sets, closest first, and
merge their components; a pair is skipped only when its two classes are in one component already, so no link between
components is lost, and no pairs are made as rows. Lists of over `BLOCK` classes are compared in blocks, each two blocks
in one task. Families beyond `FAMILY` classes or `TOKENS` tokens don't go to one task: their lists, in blocks of bounded
tokens, are settled in rounds, in each of which every component proposes its closest possible partners of other components, list by list,
until nothing is proposed.

Sets are told apart by 64-bit hashes of their tokens: two different shingles of one pair of documents agree with odds of
about 1e-13 for 1000 words, two different sets among 1e8 with odds of about 3e-4.

Defined cases: texts are compared in lower case (A-Z); a text of fewer words than n is one token, a text without words
(or null) has none and is linked with nothing; rows without a doc_id take no part in links; repeated doc_ids are rows of
one document; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected
from .runtime import Table, bucket_count, fixed, fresh, hinted, in_small_batches
from .textcode import Words, chunks, column, deltas, mix, seeded, undeltas, windows

_BAND = 1.5
#: Sketch positions of a part.
_WIDE = 1 << 16
#: Classes of a list that are compared in one task.
BLOCK = 1024
#: Classes and tokens of a family that one task settles.
FAMILY, TOKENS = 4096, 3_000_000
#: Tokens of a block of a list of a larger family.
BLOCK_TOKENS = 1_000_000
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_OUT = pa.schema([("kind", pa.int32()), ("name", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])
_PARTS, _DOCS, _MEMBER, _DOC = 0, 1, 0, 1
U = np.uint64


class Bound:
    """What a similarity of num / den or more means for sizes and differences."""

    def __init__(self, num: int, den: int):
        if 5 * num < 4 * den:
            raise ValueError("bands and parts are laid out for a similarity of 0.8 or more")
        self.num, self.den = num, den

    def difference(self, sizes: np.ndarray | int):
        """The largest symmetric difference of linked sets whose sizes add up to this."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)

    def largest(self, size: int) -> int:
        return size * self.den // self.num

    def bands(self, upto: int) -> list[int]:
        """Edges: band i holds sizes from edge i up to, not including, edge i + 1."""
        found = [1]
        while found[-1] <= upto:
            found.append(max(found[-1] + 1, math.floor(found[-1] * _BAND)))
        return found

    def parts(self, last_size: int) -> tuple[int, int]:
        """(T, P) of a band whose largest size is this."""
        t = self.difference(2 * last_size)
        return t, t + 1 + math.ceil(t / 4)


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, tokens): text d has the distinct sorted tokens first[d]:first[d + 1]."""
    w = Words(texts, lower=True)
    h, many = w.hashes(), np.diff(w.first)
    win = windows(h, n)
    doc = np.repeat(np.arange(w.texts), many)
    whole = np.arange(len(win)) + n <= w.first[doc[: len(win)] + 1]
    short = np.flatnonzero((many > 0) & (many < n))
    extra = np.zeros(len(short), U)
    for i, d in enumerate(short):
        extra[i] = seeded(windows(h[w.first[d] : w.first[d + 1]], int(many[d])), 99)[0]
    t, d = np.concatenate([win[whole], extra]), np.concatenate([doc[: len(win)][whole], short])
    by = np.lexsort((t, d))
    t, d = t[by], d[by]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    return np.searchsorted(d[new], np.arange(w.texts + 1)), t[new]


def set_name(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set; its kind is that of a long."""
    return int(np.int64(mix(np.array([seeded(tokens, 3).sum(dtype=U) ^ U(len(tokens))], U)).view(np.int64)[0]))


def part_keys(tokens: np.ndarray, bound: Bound) -> np.ndarray:
    """The join keys of a set."""
    size = len(tokens)
    edges = bound.bands(bound.largest(size))
    band_of = lambda s: np.searchsorted(edges, s, "right") - 1
    found = []
    for band in range(band_of(size), band_of(bound.largest(size)) + 1):
        t, p = bound.parts(edges[band + 1] - 1)
        bit = seeded(seeded(tokens, 12) % U(_WIDE), 13)
        for deal in itertools.count():  # ends: the share of parts that hold a token is the same in every deal
            part = (seeded(tokens, 100 + deal) % U(p)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            sizes = np.bincount(part, minlength=p)
            held = np.flatnonzero(sizes)
            key = np.bitwise_xor.reduceat(bit[by], (np.cumsum(sizes) - sizes)[held])  # equal bits cancel, as in the sketch
            below = np.cumsum(np.bincount(np.minimum(sizes, 63), minlength=64))  # parts of at most i tokens
            c = int(np.searchsorted(below, p - t))
            sent = sizes[held] >= c
            found.append(mix(key[sent] ^ seeded(held[sent].astype(U) + U((deal << 50) + (band << 40)), 14)))
            if c:
                break
            # too many parts are empty to be sure of an equal one: all are sent, and another deal is tried; of two
            # partners the one that stops first is sure of an equal part in a deal that both have sent
    return np.unique(np.concatenate(found))


def sketch_bits(size: int) -> int:
    """Bits of the sketch that a set of this size gets at first."""
    return max(256, 1 << (max(int(size), 1) - 1).bit_length())


def sketch(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch: each token flips one bit."""
    odd = np.bincount((seeded(tokens, 31) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _dealt(batches, n: int, bound: Bound, buckets: int):
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    for turn, chunk in enumerate(chunks(batches, "text")):
        first, tokens = sets(column(chunk, "text"), n)
        ids = column(chunk, "doc_id").to_pylist()
        names = [set_name(tokens[first[d] : first[d + 1]]) if first[d] < first[d + 1] else None for d in range(len(ids))]
        size = np.diff(first)
        rows = [(int(mix(np.array([(part << 24) + turn], U))[0] % U(buckets)), _DOCS, np.array(ids, "<i8").tobytes(), size.astype("<i8").tobytes(), np.array([x or 0 for x in names], "<i8").tobytes(), b"".join(sketch(tokens[first[d] : first[d + 1]], sketch_bits(size[d])).tobytes() for d in range(len(ids)) if size[d]))]
        seen: dict[int, int] = {}
        for d, x in enumerate(names):
            if x is not None:
                seen.setdefault(x, d)
        keys = [part_keys(tokens[first[d] : first[d + 1]], bound) for d in seen.values()]
        if keys:
            node = np.array(list(seen), np.int64)
            who = np.repeat(np.arange(len(node)), [len(k) for k in keys])
            key = np.concatenate(keys)
            bucket = (key >> U(20)) % U(buckets)
            split = np.argsort(bucket.astype(np.int64), kind="stable")
            edges = np.searchsorted(bucket[split], np.arange(buckets + 1, dtype=U))
            for b in np.flatnonzero(np.diff(edges)):
                own = split[edges[b] : edges[b + 1]]
                there, place = np.unique(who[own], return_inverse=True)
                rows.append((int(b), _PARTS, key[own].astype("<u8").tobytes(), deltas(place), node[there].astype("<i8").tobytes(), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT)


def _listed(table: pa.Table) -> pa.Table:
    """Passes documents on; of each different set of classes that share a key, one row per member."""
    kind, name, n, node, sketches = [], [], [], [], []
    key, who = [], []
    for k, a, b, c, d in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c", "d")), strict=True):
        if k == _DOCS:
            ids = np.frombuffer(a, "<i8")
            kind.append(np.full(len(ids), _DOC))
            name.append(ids)
            n.append(np.frombuffer(b, "<i8"))
            node.append(np.frombuffer(c, "<i8"))
            ends = np.cumsum([sketch_bits(int(x)) // 8 if x else 0 for x in n[-1]]).tolist()
            sketches += [d[i:j] or None for i, j in zip([0, *ends], ends, strict=False)]
        else:
            key.append(np.frombuffer(a, "<u8"))
            who.append(np.frombuffer(c, "<i8")[undeltas(b)])
    if key:
        key, who = np.concatenate(key), np.concatenate(who)
        by = np.lexsort((who, key))
        key, who = key[by], who[by]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[new], who[new]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[edge, len(key)])
        label = mix(np.add.reduceat(seeded(who.view(U), 21), edge)) ^ many.astype(U)
        _, one = np.unique(label, return_index=True)
        one = one[many[one] > 1]
        at = np.repeat(edge[one], many[one]) + np.arange(many[one].sum()) - np.repeat(np.cumsum(many[one]) - many[one], many[one])
        kind.append(np.full(len(at), _MEMBER))
        name.append(np.repeat(label[one].view(np.int64), many[one]))
        n.append(np.repeat(many[one], many[one]))
        node.append(who[at])
        sketches += [None] * len(at)
    cols = [*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kind, name, n, node)), sketches]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT.types, strict=True)], schema=_OUT)


def _lists(x: pa.ChunkedArray) -> list[np.ndarray]:
    """The values of a binary column as arrays of 64-bit hashes, without copying them."""
    found = []
    for part in x.chunks:
        part = part.cast(pa.large_binary())
        _, offsets, data = part.buffers()
        off = np.frombuffer(offsets, np.int64, len(part) + 1, part.offset * 8)
        found += [np.frombuffer(data, "<u8", int(b - a) // 8, int(a)) if b > a else np.zeros(0, U) for a, b in zip(off[:-1], off[1:], strict=True)]
    return found


def _sketches(sets_: list[np.ndarray], limit: int = 8 << 20) -> np.ndarray:
    """Sketches of one length, if possible two bits for each token of the largest set; one row per set."""
    bits = 2 * sketch_bits(max(map(len, sets_)))
    while bits > 256 and bits // 8 * len(sets_) > limit:
        bits //= 2
    return np.array([sketch(t, bits) for t in sets_])


def _possible(bound: Bound, s: np.ndarray, n: np.ndarray, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    """(whether sizes and sketches allow a link, sketch distance) of pairs."""
    a, b = n[rows][:, None], n[cols][None, :]
    dist = np.zeros((a.shape[0], b.shape[1]), np.int64)
    for word in range(s.shape[1]):
        dist += np.bitwise_count(s[rows, word][:, None] ^ s[cols, word][None, :])
    return (dist <= bound.difference(a + b)) & (bound.num * a <= bound.den * b) & (bound.num * b <= bound.den * a), dist


def _families(table: pa.Table, bound: Bound) -> pa.Table:
    """u, v: joins the classes of two blocks of a list (or of one) that sizes and sketches allow to be linked."""
    n = table.column("size").to_numpy()
    by = np.argsort(n, kind="stable")
    n, node = n[by], table.column("node").to_numpy()[by]
    raw = _lists(table.column("sketch"))
    raw = [raw[i] for i in by]
    words = np.array([len(x) for x in raw])
    folded: dict[int, tuple[int, np.ndarray]] = {}
    comp = np.arange(len(n))
    for i in range(0, len(n), 64):
        low = int(np.searchsorted(n, -(-n[i] * bound.num // bound.den)))
        size = int(words[low])
        if size not in folded:
            start = int(np.searchsorted(words, size))
            folded[size] = start, np.array([np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in raw[start:]])
        start, s = folded[size]
        may, _ = _possible(bound, s, n[start:], slice(i - start, i - start + 64), slice(low - start, i - start + 64))
        for r in range(i, min(i + 64, len(n))):
            found = np.unique(comp[low:r][may[r - i, : r - low]])
            if len(found) and (len(found) > 1 or found[0] != comp[r]):
                comp[np.isin(comp, np.append(found, comp[r]))] = min(found[0], comp[r])
    moved = comp != np.arange(len(n))
    return pa.table({"u": node[moved], "v": node[comp[moved]]})


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _settled(table: pa.Table, bound: Bound) -> pa.Table:
    """node, comp of a family's classes."""
    node, first = np.unique(table.column("node").to_numpy(), return_index=True)
    raw = _lists(table.column("tokens"))
    tokens = [raw[i] for i in first]
    by = np.argsort([len(t) for t in tokens], kind="stable")
    node, tokens = node[by], [tokens[i] for i in by]
    n, s, comp = np.array([len(t) for t in tokens]), _sketches(tokens), np.arange(len(node))
    step = 64
    for i in range(0, len(node), step):
        low = int(np.searchsorted(n, -(-n[i] * bound.num // bound.den)))
        may, dist = _possible(bound, s, n, slice(i, i + step), slice(low, i + step))
        for r in range(i, min(i + step, len(node))):
            others = np.flatnonzero(may[r - i, : r - low]) + low
            others = others[np.argsort(dist[r - i, others - low], kind="stable")]
            while len(others := others[comp[others] != comp[r]]):
                j, others = others[0], others[1:]
                if bound.linked(_common(tokens[r], tokens[j]), n[r], n[j]):
                    comp[comp == comp[r]] = comp[j]
    return pa.table({"node": node, "comp": node[comp]})


def _wanted(batches, n: int):
    """family, node, n, tokens of documents that stand for their class."""
    for chunk in chunks(batches, "text"):
        first, tokens = sets(column(chunk, "text"), n)
        rows = []
        for d, (family, node) in enumerate(zip(column(chunk, "family").to_pylist(), column(chunk, "node").to_pylist(), strict=True)):
            t = tokens[first[d] : first[d + 1]]
            if len(t) and set_name(t) == node:
                rows.append((family, node, len(t), t.astype("<u8").tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["family", "node", "n", "tokens"])


_BEST = pa.schema([("list", pa.int64()), ("comp", pa.int64()), ("dist", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _proposals(table: pa.Table, bound: Bound) -> pa.Table:
    """For each class of two blocks of a list the closest possible partner of another component, if any."""
    node, comp, block = (table.column(x).to_numpy() for x in ("node", "comp", "block"))
    tokens = _lists(table.column("tokens"))
    refuted = [set(x or ()) for x in table.column("refuted").to_pylist()]
    n, s = np.array([len(t) for t in tokens]), _sketches(tokens)
    across = block.min() != block.max()
    rows = []
    for i in range(0, len(node), 64):
        may, dist = _possible(bound, s, n, slice(i, i + 64), slice(0, len(node)))
        may &= comp[i : i + 64][:, None] != comp[None, :]
        if across:
            may &= block[i : i + 64][:, None] != block[None, :]
        for r in np.flatnonzero(may.any(1)):
            others = np.flatnonzero(may[r])
            order = others[np.lexsort((node[others], dist[r, others]))]
            j = next((x for x in order if int(node[x]) not in refuted[i + r]), None)
            if j is not None:
                a, b = int(node[i + r]), int(node[j])
                rows.append((table.column("list")[0].as_py(), int(comp[i + r]), int(dist[r, j]), min(a, b), max(a, b)))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_BEST)


def _verified(batches, bound: Bound):
    for batch in batches:
        rows = []
        for a, b, x, y in zip(*(column(batch, c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            rows.append((a, b, bool(bound.linked(_common(x, y), len(x), len(y)))))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "linked"])


def _blocked(lists: DataFrame, block: int) -> DataFrame:
    """list, node with the number of the list's blocks (`per`) and the node's block."""
    per = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    return lists.select("list", "node", per.alias("per")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("per")).cast("int"))


def _by_tokens(lists: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """list, node, per, block of lists whose blocks are bounded by classes and by tokens. sizes: node, n."""
    held = lists.select("list", "node").join(sizes, "node")
    need = held.groupBy("list").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_TOKENS), F.lit(1)).cast("int").alias("per"))
    return held.select("list", "node").join(need, "list").withColumn("block", F.pmod(F.xxhash64("node"), F.col("per")).cast("int"))


def _meets() -> Column:
    """The pairs of blocks that a node of `block` is in."""
    return F.transform(F.sequence(F.lit(0), F.col("per") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))


def _in_rounds(lists: DataFrame, held: DataFrame, bound: Bound) -> DataFrame:
    """node, comp of families too large for one task. lists: list, node, per, block; held: node, n, tokens."""
    state = Table(held.select("node", F.col("node").alias("comp")), "state")
    refused: Table | None = None
    placed = Table(lists, "placed")
    live = placed.df
    first = True
    while True:
        shown = live.join(state.df, "node").select("list", "node", "comp", "block", F.explode(_meets()).alias("m"))
        sets_ = held.select("node", "tokens")
        if refused is not None:
            each = refused.df.select(F.col("a").alias("node"), "b").unionByName(refused.df.select(F.col("b").alias("node"), F.col("a").alias("b")))
            sets_ = sets_.join(each.groupBy("node").agg(F.collect_set("b").alias("refuted")), "node", "left")
        else:
            sets_ = sets_.withColumn("refuted", F.array().cast("array<bigint>"))
        best = Table(shown.join(sets_, "node").groupBy("list", "m").applyInArrow(fixed(_proposals, bound), "list long, comp long, dist long, a long, b long"), "best")
        nth = F.row_number().over(Window.partitionBy("comp").orderBy("dist", "a", "b"))
        pairs = best.df.select("comp", "dist", "a", "b").distinct().withColumn("nth", nth).filter(F.col("nth") <= (1 if first else 4)).select("a", "b").distinct()
        x, y = held.select(F.col("node").alias("a"), F.col("tokens").alias("x")), held.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        checked = Table(pairs.join(x, "a").join(y, "b").mapInArrow(fixed(_verified, bound), "a long, b long, linked boolean"), "checked")
        if not checked.df.limit(1).count():
            return state.df
        # a list that proposes nothing never will: components only merge, and refuted pairs only become more
        live, first = placed.df.join(best.df.select("list").distinct(), "list", "left_semi"), False
        comp = state.df
        ends = checked.df.filter("linked").join(comp.select(F.col("node").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("v")), "b")
        moved = connected(ends.select("u", "v"))
        new = Table(comp.join(moved.df.select(F.col("u").alias("comp"), F.col("v").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "state")
        no = checked.df.filter("not linked").select("a", "b")
        refused = Table(no if refused is None else refused.df.unionByName(no).distinct(), "refuted")
        state = new


def components(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5), block: int = BLOCK, family: int = FAMILY, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    bound = Bound(similarity.numerator, similarity.denominator)
    buckets = bucket_count(docs)
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = in_small_batches(known).mapInArrow(fixed(_dealt, n, bound, buckets), "bucket int, kind int, a binary, b binary, c binary, d binary")
    listed = Table(sent.groupBy("bucket").applyInArrow(_listed, "kind int, name long, n long, node long, sketch binary"), "listed")
    rows = listed.df.filter(F.col("kind") == _DOC).select(F.col("name").alias("doc_id"), F.col("n").alias("n_shingles"), "node")
    lists = Table(_blocked(listed.df.filter(F.col("kind") == _MEMBER).select(F.col("name").alias("list"), "n", "node").distinct(), block), "lists")
    classes = listed.df.filter((F.col("kind") == _DOC) & (F.col("n") > 0)).join(hinted(Table(lists.df.select("node").distinct(), "in-lists"), 24 << 20), "node", "left_semi")
    classes = Table(classes.groupBy("node").agg(F.first("n").alias("size"), F.first("sketch").alias("sketch")), "sketches")
    pairs = lists.df.join(hinted(classes, 32 << 20), "node").select("list", F.explode(_meets()).alias("m"), "node", "size", "sketch")
    joined = connected(pairs.groupBy("list", "m").applyInArrow(fixed(_families, bound), "u long, v long"))

    named = Table(joined.df.select(F.col("u").alias("node"), F.col("v").alias("family")).unionByName(joined.df.select(F.col("v").alias("node"), F.col("v").alias("family")).distinct()), "families")
    standing = rows.filter("n_shingles > 0").join(hinted(named, 24 << 20), "node").groupBy("node", "family").agg(F.min("doc_id").alias("_id"), F.first("n_shingles").alias("size"))
    standing = Table(standing, "standing")
    large = Table(standing.df.groupBy("family").agg(F.count("*").alias("c"), F.sum("size").alias("t")).filter((F.col("c") > family) | (F.col("t") > tokens)).select("family"), "large")
    any_large = large.df.limit(1).count() > 0
    text = known.join(hinted(standing, 24 << 20), F.col("doc_id") == F.col("_id")).select("family", "node", "text")
    held = in_small_batches(text).mapInArrow(fixed(_wanted, n), "family long, node long, n long, tokens binary")
    if any_large:
        held = Table(held, "sets").df
        big = held.join(hinted(large), "family", "left_semi").dropDuplicates(["node"])
        theirs = lists.df.join(hinted(named), "node").join(hinted(large), "family", "left_semi").select("list", "node")
        big = Table(big, "large-sets")
        in_rounds = _in_rounds(_by_tokens(theirs, big.df.select("node", "n"), block), big.df, bound)
        held = held.join(hinted(large), "family", "left_anti")
    state = held.groupBy("family").applyInArrow(fixed(_settled, bound), "node long, comp long")
    state = Table(state if not any_large else state.unionByName(in_rounds), "state")

    joined = rows.filter("n_shingles > 0").join(hinted(state, 24 << 20), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    joined = Table(joined.select("doc_id", "n_shingles", "comp"), "classes")
    least = joined.df.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")).filter("members > 1").drop("members")
    linked = joined.df.join(hinted(Table(least, "least")), "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = docs.filter("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(alone).unionByName(nameless)


def deduplicated(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the document with the smallest doc_id. Rows without a doc_id stay."""
    (name,) = fresh(docs, "_gone")
    gone = Table(components(docs, n, similarity).filter("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(hinted(gone, 24 << 20), F.col("doc_id").cast("long") == F.col(name), "left_anti")
