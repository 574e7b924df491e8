"""Operators against brute force where an approximation would lose results."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from tidewright.llm import pii, substring_dedup, suffix_dedup

from . import brute
from .conftest import frame


def families(seed: int, n: int, copies: int, words: int, edits: int) -> list[tuple[int, str]]:
    """Near copies: each text of a family is its base with some words replaced."""
    r = random.Random(seed)
    texts = []
    for f in range(n):
        base = [f"w{f}_{r.randrange(200)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for e in range(edits):
                w[r.randrange(words)] = f"x{len(texts)}_{e}"
            texts.append(" ".join(w))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_suffix_dedup_equals_brute_force_on_edited_families(spark):
    rows = families(1, 40, 12, 300, 8)
    got = suffix_dedup.deduplicated(frame(spark, rows), 50).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in got} == brute.windows(rows, 50)
    assert {r.doc_id: r.n_repeated for r in got} == brute.repeated(rows, 50)


def test_pii_terms_of_a_fixed_signature_and_far_from_the_address(spark):
    filler = " ".join(["and so the long day went on by the river"] * 4)
    template = "with the kindest regards from all of us here in the office of Quillon"  # over 60 characters, alike in every text
    rows = [(i, f"item{i} {filler} {template} quil@corp.example {filler}") for i in range(5)]
    rows += [(i, f"Brontes wrote item{i} {filler} to bron@corp.example") for i in range(10, 15)]
    rows += [(i, f"item{i} {filler} with the kindest regards from all of us here in the office wrote") for i in range(20, 120)]
    df = frame(spark, rows)
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert not any("Quillon" in out[i] or "<EMAIL>" not in out[i] for i in range(5))
    assert not any("Brontes" in out[i] or "<EMAIL>" not in out[i] for i in range(10, 15))
    assert all(out[i] == t for i, t in rows if i >= 20)
    assert filler in out[0] and filler in out[10]
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert "term:0:7" in spans[10]


def test_substring_level_treats_repeated_rows_alike():
    window = " ".join(f"w{i}" for i in range(7))

    def chunk(*rows):
        ids, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "h": pa.array([10 * i for i in ids], pa.int64()), "text": list(texts)})

    x, y = (2, f"a {window} b"), (9, f"c {window} d")
    sent = pa.Table.from_batches([s for c in (chunk(x, y), chunk(x)) for s in substring_dedup._level([c], 7, None, False, 1)])
    answered = substring_dedup._answers(sent, False)
    maps = [substring_dedup._bitmaps(answered.filter(pa.compute.equal(answered.column("chunk"), c))).to_pylist() for c in set(sent.column("chunk").to_pylist())]
    assert [r["bits"] for m in maps for r in m if r["b_id"] == 2] == [bytes([0b01000000, 0])] * 2


def test_pii_terms_equal_brute_force(spark):
    r = random.Random(5)
    names, rows = ["Vintar", "Q", "Osk99", "Melba" * 12, "and"], []
    for i in range(160):
        words = [f"w{r.randrange(300)}" for _ in range(r.randrange(5, 40))]
        if i % 4 == 0:
            k = r.randrange(4)
            for x in (names[k], f"{names[k].lower()[:5]}@host{k}.example", f"10.0.0.{k}", f"+1 555 010 {1000 + k}"):
                words.insert(r.randrange(len(words)), x)
        words.insert(0, names[4] if i % 3 else f"x{i}@y.example{names[0]}")
        rows.append((i, " ".join(words)))
    rows.append((500, None))
    spans, found = brute.disclosing(rows)
    got = {x.doc_id: x.spans for x in pii.report(frame(spark, rows)).collect()}
    assert spans and {(i, int(a), int(b)) for i, s in got.items() for kind, a, b in (x.split(":") for x in s.split(",") if s) if kind == "term"} == spans
    mentions = pii.mentions(pii.base_spans(frame(spark, rows)))
    scored = {(x.entity, x.term): x.disclosure for x in pii.disclosing(frame(spark, rows), mentions).collect()}
    assert scored.keys() == found.keys() and all(abs(scored[k] - found[k]) < 1e-9 for k in found)


def test_pii_of_very_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"u{i}@h.example \U0001f600 10.1.{i % 256}.{i // 256 % 256}" for i in range(50_000))  # 100,000 spans
    started = time.time()
    got = pii.report(frame(spark, [(1, text), (2, "plain")], 1)).collect()
    assert {x.doc_id: (x.n_email, x.n_ip) for x in got} == {1: (50_000, 50_000), 2: (0, 0)}
    assert {x.base_sha256 for x in got if x.doc_id == 1} == {brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(text)))}
    out = {x.doc_id: x.text for x in pii.redacted(frame(spark, [(1, text), (2, "plain")], 1)).collect()}
    assert out == {1: " ".join("<EMAIL> \U0001f600 <IP>" for _ in range(50_000)), 2: "plain"}
    print("seconds", time.time() - started)


def test_suffix_dedup_of_pairs_hidden_by_decoys(spark):
    """Two documents share just 50 words; others of smaller doc_id share more of them on either side, but never 50."""
    r = random.Random(2)
    rows, big = [], 100_000
    for f in range(12):
        words = [f"w{f}_{k}" for k in range(50)]
        pair = [[f"p{f}_{side}_{k}" for k in range(20)] + words + [f"q{f}_{side}_{k}" for k in range(20)] for side in range(2)]
        for side, w in enumerate(pair):
            rows.append((big + 2 * f + side, " ".join(w)))
            for cut in (0, 10, 25, 40, 49):  # one word of the 50 differs
                d = w[5:-5]
                d[15 + cut] = f"x{f}_{side}_{cut}"
                rows.append((len(rows), " ".join(d)))
    r.shuffle(rows)
    got = suffix_dedup.deduplicated(frame(spark, rows, 5), 50).collect()
    assert {(x.doc_id, x.n_words, x.n_removed, brute.sha(x.kept_text)) for x in got} == brute.windows(rows, 50)
    assert {x.doc_id: x.n_repeated for x in got} == brute.repeated(rows, 50)


def test_substring_levels_send_documents_in_few_bytes():
    """op3's disk: many buckets get one or two windows of a document each, and had eight bytes for its order with them."""
    for ids in ([], [5], [-(1 << 63), -3, -3, 0, 70000, (1 << 63) - 1], range(0, 900, 3)):
        assert len(ids) == 0 or substring_dedup._ungaps(substring_dedup._gaps(np.array(ids, np.int64))).tolist() == list(ids)
    texts = [" ".join(f"w{d}_{i}" for i in range(300)) for d in range(40)]
    chunk = pa.table({"doc_id": pa.array([(7 * d) % 40 for d in range(40)]), "h": pa.array(range(40)), "text": texts}).to_batches()[0]
    (sent,) = substring_dedup._level([chunk], 7, None, False, 500)
    entries = sent.filter(pa.compute.equal(sent.column("kind"), substring_dedup._ENTRIES))
    assert sum(len(x.as_py() or b"") for c in "abcd" for x in entries.column(c)) < 12 * 40 * 294


def test_shuffle_files_are_released_at_once(spark):
    """op3's disk: the exchange of a level is gone before the next one is written."""
    import time

    from pyspark.sql import functions as F

    from tidewright.operators.iterate import released, written

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    for _ in range(3):
        released(spark)
        time.sleep(1.5)
    before = held()
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    table = written(df, "released")
    assert held() > before and table.count() == 10
    del df
    released(spark)
    until = time.time() + 2
    while held() > before and time.time() < until:
        time.sleep(0.1)
    assert held() <= before
