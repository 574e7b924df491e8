import bisect
import collections
import uuid
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as tokenizer_files
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import best_fit_packing, byte_bpe, components, exact_dedup, ngram_join, pii, quality, queries, sharding, substring_dedup, suffix_dedup, topk_search
from tidewright.llm.runtime import ARROW_BYTES, work_dir

from . import brute
from .conftest import frame

GPT, MULTI = tokenizer_files.path("byte_bpe_50k.tiktoken"), tokenizer_files.path("byte_bpe_multi_50k.tiktoken")


# packing


def check_packing(rows, packed, capacity, ids):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, own in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity) and 0 < r.length <= capacity
            assert zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i]) and (len(own) == 1) == (at <= capacity)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing_against_the_tokenizer_itself(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: e.ids + [2] for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True)}
    packed = best_fit_packing.pack(docs, GPT, tokenizer_files.PATTERN, capacity=256).collect()
    check_packing(rows, packed, 256, ids)
    assert len({r.sequence_id for r in packed}) <= 1.02 * sum(map(len, ids.values())) / 256 + 1


def test_tiktoken_equals_the_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = np.random.default_rng(0)
    odd = ["<|endoftext|> x", "\r\n\t  　 á", "it's I'LL we'Ve", "١٢٣ x² ½", "\x00\x85\x1c", " " * 50 + "x"]
    odd += ["".join(chr(c) for c in r.integers(1, 0x3000, 60)) for _ in range(50)]
    encoder = best_fit_packing.encoder(GPT, tokenizer_files.PATTERN)
    assert [encoder.encode_ordinary(x) for x in odd] == [e.ids for e in t.encode_batch(odd, add_special_tokens=False)]


def best_fit_decreasing(lengths, capacity):
    """The number of sequences of the serial algorithm."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            left = gaps.pop(i) - x
        else:
            n, left = n + 1, capacity - x
        bisect.insort(gaps, left)
    return n


@pytest.mark.parametrize("kind", ["any", "hot", "small", "halves", "none"])
def test_packing_rounds_against_serial_best_fit(spark, kind):
    r = np.random.default_rng(1)
    lengths = {"any": r.integers(1, 65, 3000), "hot": np.r_[[21] * 1500, r.integers(1, 65, 1500)], "small": np.r_[r.integers(1, 9, 2500), r.integers(40, 65, 300)], "halves": np.r_[[33] * 9, [31] * 9], "none": np.zeros(0, int)}[kind].tolist()
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "pid long, length long").repartition(4)
    packer = best_fit_packing.Packer(items, 64, rows_per_salt=1000, rows_per_sweep=700)
    got = packer.run().collect()
    used = collections.Counter()
    for x in got:
        used[x.sequence_id] += lengths[x.pid]
    assert sorted(x.pid for x in got) == list(range(len(lengths))) and max(used.values(), default=0) <= 64
    assert len(used) <= 1.03 * best_fit_decreasing(lengths, 64) + 3 and packer.rounds <= 16


def test_sweep_takes_the_smallest_gap_and_ranks_what_is_left():
    rows = sorted([(9, False, 90, 1), (7, True, 1, 1), (6, False, 60, 2), (6, True, 2, 1), (5, True, 3, 1), (5, True, 4, 1)], key=lambda x: (-x[0], x[1]))
    got = [x for b in best_fit_packing.sweep([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abcd"))], 0) for x in b.to_pylist()]
    assert [(x["id"], x["seq"]) for x in got if x["kind"] == 0] == [(1, 90), (2, 60), (3, 60)] and [(x["id"], x["at"]) for x in got if x["kind"] == 1] == [(4, 0)]
    # gaps of part 0: ranks 0, 1; of part 1: rank 0. Part 2 wants two, part 3 two: the nearest part's gaps go first
    assert best_fit_packing.meetings({0: (1, 2), 1: (0, 1), 2: (2, 0), 3: (2, 0)}) == [(2, 0, 1, 1, 1), (2, 1, 1, 0, 2), (3, 0, 1, 0, 1)]


def test_packing_repeated_null_and_empty(spark, empty):
    assert best_fit_packing.pack(empty, GPT, tokenizer_files.PATTERN).count() == 0
    got = best_fit_packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), GPT, tokenizer_files.PATTERN).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3 and {r.length for r in got if r.doc_id is None} == {1}


# exact duplicates


def test_exact_dedup(docs, rows):
    assert {tuple(r) for r in exact_dedup.verdicts(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == brute.exact(rows)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k, _ in brute.exact(rows) if k}


def test_exact_dedup_repeats_nulls_empty(spark, empty):
    assert exact_dedup.verdicts(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0
    again = frame(spark, [(5, "Aa"), (5, "aA"), (3, "aa"), (None, "AA"), (7, None), (8, "")])
    got = exact_dedup.verdicts(again).collect()
    assert sorted(r.group_size for r in got) == [2, 2, 4, 4, 4, 4]
    assert [r.doc_id for r in got if r.kept and r.group_size == 4] == [5] and [r.doc_id for r in got if r.kept and r.group_size == 2] == [8]
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(again).collect()) == [5, 8]


def test_counting_quotient_filter_is_lossless():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    b[:50] = a[:50]
    a[100:110] = a[100]
    one, two = exact_dedup.CountingQuotientFilter.of(a), exact_dedup.CountingQuotientFilter.of(b[:90])
    both = one.merge(two)
    values, counts = np.unique(np.concatenate([a, b[:90]]), return_counts=True)
    assert one.bits != two.bits and (both.fingerprints() == values).all() and (both.count == counts).all()
    assert (two.merge(one).fingerprints() == values).all()
    hot = np.repeat(a[:3], 400)  # counts and runs beyond a byte
    ranges = collections.defaultdict(list)
    for part in (a, b, hot, hot):
        for f in exact_dedup.filters(part, 3):
            ranges[f.range].append(exact_dedup.CountingQuotientFilter.from_bytes(f.to_bytes()))
    found = [exact_dedup.merged(ranges[k]) for k in sorted(ranges)]
    values, counts = np.unique(np.concatenate([a, b, hot, hot]), return_counts=True)
    assert (np.concatenate([f.fingerprints() for f in found]) == values).all() and (np.concatenate([f.count for f in found]) == counts).all()


# substrings


@pytest.mark.parametrize("broadcast", [None, 0])
def test_substring_dedup(docs, rows, broadcast):
    got = substring_dedup.deduplicated(docs, 13, digest=True, broadcast_bytes=broadcast)
    assert {tuple(r) for r in got.collect()} == brute.windows(rows, 13)


def test_substring_levels_and_edge_cases(spark, empty):
    assert substring_dedup.lengths(13) == [7, 13] and substring_dedup.lengths(50) == [7, 13, 25, 50] and substring_dedup.lengths(5) == [5]
    assert substring_dedup.deduplicated(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r for r in substring_dedup.deduplicated(frame(spark, [(2, text), (2, text), (None, text + " x"), (9, text)])).collect()}
    assert (got[2].n_removed, got[9].n_removed, got[None].n_removed, got[None].kept_text) == (0, 20, 20, "x")


def test_suffix_dedup(docs, rows):
    got = suffix_dedup.deduplicated(docs, 50).collect()
    expected = brute.repeated(rows, 50)
    assert {r.doc_id: r.n_repeated for r in got} == expected
    texts = {i: brute.words(t) for i, t in rows}
    kept = " \n ".join(r.kept_text for r in got)
    for r in got:
        assert len(r.kept_text.split()) == r.n_words - r.n_removed
        for a, b in (map(int, s.split(":")) for s in r.repeated.split(",") if s):
            assert " ".join(texts[r.doc_id][a : a + 5]) in kept  # of what repeats, a copy stays


def test_suffix_dedup_edge_cases(spark, empty):
    assert suffix_dedup.deduplicated(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(frame(spark, [(2, text), (2, text), (None, text), (1, None), (3, "")])).collect()}
    assert (got[2].n_removed, got[None].n_removed, got[1].n_words, got[3].n_repeated) == (0, 60, 0, 0)


# search


def brute_top(vectors, queries, k):
    out = set()
    for q in queries:
        s = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q))[:k]
        out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("strip,batch", [(8192, 2048), (64, 3)])
def test_top_k(spark, strip, batch):
    r = np.random.default_rng(0)
    vectors = {i: [int(x) for x in r.integers(-4, 5, 6)] for i in range(0, 400, 2)}  # many ties
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<long>")
    got = topk_search.top_k(df, F.col("id") % 20 == 0, 5, strip, batch).collect()
    assert {tuple(x) for x in got} == brute_top(vectors, [i for i in vectors if i % 20 == 0], 5)


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, -0.001]), (1, [float("nan"), 1.0]), (2, None), (3, [float("inf")]), (4, [0.5, None]), (50, [0.25, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").filter(topk_search.usable(F.col("embedding")))
    cells = df.select(F.col("vec_id").alias("id"), topk_search.quantised(F.col("embedding")).alias("v"))
    assert {tuple(x) for x in topk_search.top_k(cells, F.col("id") % 50 == 0).collect()} == {(0, 1, 50, 256 * 64 - 512), (50, 1, 0, 256 * 64 - 512)}
    assert topk_search.top_k(cells.filter("id < 0"), F.col("id") % 50 == 0).count() == 0
    again = spark.createDataFrame([(0, [2]), (0, [1]), (2, [3, 9])], "id long, v array<long>")
    assert [tuple(x) for x in topk_search.top_k(again, F.col("id") % 50 == 0).collect()] == [(0, 1, 2, 3)]
    for large in (1e30, 1e12):
        rows = spark.createDataFrame([(0, [large]), (1, [large])], "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk_search.quantised(F.col("embedding")).alias("v"))
        with pytest.raises(Exception, match="too large for 64-bit scores"):
            topk_search.top_k(rows, F.col("id") == 0).collect()


def test_strips_that_cannot_enter_get_no_queries():
    q, high, low = np.array([[2, -1]]), np.array([[5, 5], [1, 9]]), np.array([[-5, -5], [0, 3]])
    assert topk_search.bounds(q, high, low).tolist() == [[15, -1]]


# n-gram join


@pytest.mark.parametrize("n,num,den,limits", [(4, 85, 100, {}), (5, 4, 5, {}), (4, 85, 100, {"block": 3, "family": 2, "tokens": 100}), (1, 9, 10, {})])
def test_ngram_join(docs, rows, n, num, den, limits):
    got = {tuple(r) for r in ngram_join.components(docs, n, Fraction(num, den), **limits).collect()}
    assert got == brute.linked(rows, n, num, den)


def test_ngram_join_edge_cases(spark, empty):
    assert ngram_join.components(empty).count() == 0 and ngram_join.deduplicated(empty).count() == 0
    got = ngram_join.components(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F"), (1, None), (2, "")]))
    assert sorted((str(r.doc_id), r.component_id) for r in got.collect()) == [("1", 1), ("2", 2), ("4", 4), ("4", 4), ("9", 4), ("None", None)]


def test_part_keys_keep_every_link():
    r = np.random.default_rng(0)
    for num, den in ((85, 100), (4, 5)):
        bound = ngram_join.Bound(num, den)
        for size in [*range(1, 40), 100, 333, 1000]:
            for _ in range(6):
                a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
                drop = r.integers(0, size // 6 + 1)
                add = r.integers(0, size // 6 + 1)
                b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**64, add, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if common and bound.linked(common, len(a), len(b)):
                    assert len(np.intersect1d(ngram_join.part_keys(a, bound), ngram_join.part_keys(b, bound)))


def test_components_both_ways(spark):
    r = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(edges, "u long, v long")
    one, many = ({tuple(x) for x in components.connected(df, limit).df.collect()} for limit in (1 << 30, 0))
    assert one == many and (1040, 1000) in one


# byte-level BPE


def test_bpe_equals_tiktoken_and_round_trips(docs, rows):
    encoder = best_fit_packing.encoder(MULTI, tokenizer_files.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.encoded(docs, MULTI, tokenizer_files.PATTERN).collect()}
    assert {i: list(encoder.encode_ordinary(t or "")) for i, t in rows} == {i: r.ids for i, r in got.items()}
    assert all(bytes(got[i].decoded).decode() == (t or "") for i, t in rows)


def test_bpe_long_and_odd_splits():
    bpe, encoder = byte_bpe.ByteBPE(MULTI, tokenizer_files.PATTERN), best_fit_packing.encoder(MULTI, tokenizer_files.PATTERN)
    r = np.random.default_rng(0)
    odd = ["a" * 5000, "ab" * 700, "ha" * 60, "é" * 64, "中文" * 90, " " * 300, "\x00\x01", "".join(chr(c) for c in r.integers(1, 0x2FFF, 400))]
    odd += ["".join(r.choice(list("abe rt"), 300)) for _ in range(20)]
    assert bpe.encode_batch(odd) == [list(encoder.encode_ordinary(x)) for x in odd]
    assert [bpe.decode(x) for x in bpe.encode_batch(odd)] == [x.encode() for x in odd]


def test_bpe_empty(empty):
    assert byte_bpe.encoded(empty, MULTI, tokenizer_files.PATTERN, digest=True).count() == 0


# sharding


def shard_store(spark, **options):
    return sharding.ShardStore(spark, f"{work_dir(spark)}/test-{uuid.uuid4().hex}", **{"target_bytes": 1 << 20, "fanout": 3, "smallest": 1 << 10, **options})


def folders(store):
    return [s.getPath().getName() for s in store._fs.listStatus(store._path(f"{store.root}/runs"))]


def test_sharding(spark, docs, empty):
    store = shard_store(spark)
    assert store.append(empty) == 1 and store.read().count() == 0 and store.placed("doc_id").count() == 0
    assert store.append(empty.withColumn("feed", F.lit(1)), by="feed") == 2 and store.read().columns == docs.columns and store.placed("doc_id").count() == 0
    for _ in range(2):
        store.append(docs)
    assert store.append(docs.withColumn("feed", F.pmod("doc_id", F.lit(5))), by="feed") == 5
    before = sorted(map(str, docs.union(docs).union(docs).collect()))
    old, reader = store.manifest(), store.read()
    assert sorted(map(str, store.read().collect())) == before
    store.compact()
    new = store.manifest()
    assert new["version"] > old["version"] and len(new["runs"]) < len(old["runs"])
    assert sorted(map(str, reader.collect())) == before  # a reader keeps its version during compaction
    assert sorted(map(str, store.read().collect())) == before and sum(r["rows"] for r in new["runs"]) == len(before)
    tiers = collections.Counter(store.tier(r["bytes"]) for r in new["runs"])
    assert max(tiers.values()) < 3
    with pytest.raises(sharding.Conflict):
        store.commit(new)
    assert store.placed("doc_id").count() == len(before)
    store.vacuum()
    assert store.versions()[0] == 1  # nothing is old enough
    docs.write.parquet(f"{store.root}/runs/orphan")  # a writer died before its commit
    store.vacuum(retain_seconds=0)
    assert store.versions() == [new["version"]] and set(folders(store)) == {r["path"].split("/")[1] for r in new["runs"]}
    assert sorted(map(str, store.read().collect())) == before


def test_sharding_lost_race_and_clashing_names(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "x", 2, "m"), (2, None, 3, "n")], "doc_id long, text string, arrival int, _metadata string")
    store = shard_store(spark)
    store.append(rows.withColumn("feed", F.col("doc_id")), by="feed")
    assert sorted(map(tuple, store.read().collect())) == [(1, "x", 2, "m"), (2, None, 3, "n")]
    assert sorted((r.doc_id, "feed=" in r.shard, r.shard_bytes > 0) for r in store.placed("doc_id").collect()) == [(1, True, True), (2, True, True)]
    stale, kept = store.manifest(), folders(store)
    store.append(rows.limit(0))
    monkeypatch.setattr(store, "manifest", lambda version=None: stale)
    with pytest.raises(sharding.Conflict):
        store.append(rows)
    assert set(kept) <= set(folders(store)) and len(folders(store)) == len(kept) + 1  # the empty arrival's, not the lost one's


def test_sharding_query_on_odd_tables(spark, docs, empty, tmp_path):
    long_text = "word " * 400_000
    odd = docs.withColumn("arrival", F.lit(7)).withColumn("_metadata", F.lit("x")).unionByName(frame(spark, [(10**6, long_text), (10**6, long_text)]).withColumn("arrival", F.lit(7)).withColumn("_metadata", F.lit("x")))
    for name, df in (("odd", odd), ("none", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.op7_sharding(spark, f"{tmp_path}/{name}")
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    assert got.count() == 0


# quality


def test_quality(spark, docs, rows, empty):
    good = [(i, t, "en", "s", 0) for i, t in enumerate([" ".join(f"fine{(7 * i + k) % 90}" for k in range(30)) for i in range(80)])]
    bad = [(i + 100, t, "en", "s", 0) for i, t in enumerate(["BUY!! NOW!! " * 10 + f"CHEAP{i}!!" for i in range(80)])]
    texts = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(5000, 1), (None, 0)], "doc_id long, quality int")
    got = quality.classify(texts, labels).collect()
    assert len(got) == 160 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == (r.doc_id < 100) for r in held) >= 0.95 * len(held)
    model = quality.fit(texts, labels)
    assert {r.doc_id for r in quality.accepted(texts, model).collect()} == {r.doc_id for r in got if r.score >= 0.5}
    scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert len(scores) == len(rows) and quality.accepted(docs, model).columns == docs.columns
    assert quality.classify(empty, labels).count() == 0 and {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_never_learns_from_held_out_rows(spark):
    rows = [(i, "good words here" if i % 2 else "bad words there") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    true = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    lies = true.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, true) == quality.fit(docs, lies)).all()


# personal data


def test_pii_base_spans(docs, rows):
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in rows:
        spans, r = brute.personal(t or ""), got[i]
        n = collections.Counter(k for k, _, _ in spans)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"]) and r.base_sha256 == brute.sha(text) and r.spans.startswith(text)


def test_pii_random_and_very_long(spark):
    import random

    r = random.Random(0)
    texts = ["".join(r.choice("a1.@+- ()%_é9") for _ in range(80)) for _ in range(300)]
    texts += ["1" * 50_000, "a" * 50_000, "1 " * 30_000, "a." * 30_000 + "@b" + ".c" * 20_000, "1." * 20_000, "+1" + "(" * 30_000, "4111111111111111 " * 500]
    got = {x.doc_id: x for x in pii.report(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t)))


def test_pii_terms_and_redaction(spark, docs, empty):
    rows = [(i, f"note {i} from Zarquon{'x' * (i % 2)} at zarquon@corp.example about item{i} today") for i in range(6)] + [(i, f"note {i} about item{i} today and at length") for i in range(10, 60)]
    df = frame(spark, rows)
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert "term:" in got[0] and all("term" not in s for i, s in got.items() if i >= 10)
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert "zarquon" not in out[0].lower() and "<EMAIL>" in out[0] and "note 0" in out[0] and out[12] == dict(rows)[12]
    kept = pii.redacted(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert [r.text for r in kept.filter("text is null").collect()] == [None, None]
    assert pii.report(empty).count() == 0 and pii.redacted(empty).count() == 0


def test_small_arrow_batches_change_no_score(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        docs = frame(spark, [(i, "word " * (20_000 * (i % 3)) + str(i)) for i in range(60)] + [(99, None)], 1)
        got = {r.doc_id: r.score for r in quality.scored(docs, np.linspace(-1, 1, 1 << 10)).collect()}
        assert spark.conf.get(key) == str(ARROW_BYTES)
        spark.conf.set(key, "1000")  # a smaller limit stays, and a longer text is still scored whole
        again = {r.doc_id: r.score for r in quality.scored(docs, np.linspace(-1, 1, 1 << 10)).collect()}
        assert spark.conf.get(key) == "1000" and got == again and len(got) == 61
    finally:
        spark.conf.set(key, before)
