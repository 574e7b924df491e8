"""Operators on small inputs: hand-computed answers and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import classify, linalg, lsh, relational, tensors, topics, vectors, walks
from tidewright.sources import readers


def test_coactors(spark):
    cast = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "movieid long, actorid long")
    got = {(r.a1, r.a2): r.w for r in vectors.coactors(cast).collect()}
    assert got == {(1, 2): 2, (2, 1): 2, (1, 3): 1, (3, 1): 1, (2, 3): 1, (3, 2): 1}
    assert {(r.a1, r.a2): r.w for r in vectors.coactors(cast, diagonal=True).collect()}[(1, 1)] == 2


def test_gram_blocks_equal_the_join(spark):
    r = np.random.default_rng(0)
    x = spark.createDataFrame([(int(e), int(f), float(v)) for e in range(30) for f, v in zip(r.choice(12, 4, False), r.normal(size=4), strict=True)], "e long, f long, v double")
    joined = {(q.a1, q.a2): q.w for q in vectors.gram(x, "e", "f", "v").filter("a1 <= a2").collect()}
    blocks = {(q.a1, q.a2): q.w for q in vectors.gram_blocks(x, "e", "f", "v", block=7).collect()}
    assert joined.keys() == blocks.keys() and all(joined[k] == pytest.approx(blocks[k]) for k in joined)


def test_restart_walk(spark):
    x = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "id long, f long, v double")
    p = {r.id: r.p for r in walks.restart_walk(x, walks.seeds(spark, [1]), tolerance=1e-9).collect()}
    assert sum(p.values()) == pytest.approx(1) and p[1] == pytest.approx(0.925) and p[2] == pytest.approx(0.075)


def test_walk_equals_the_dense_iteration(spark):
    r = np.random.default_rng(1)
    m = np.where(r.random((8, 5)) < 0.6, r.random((8, 5)), 0)
    m[:, 0] += 0.1
    x = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(8) for j in range(5) if m[i, j]], "id long, f long, v double")
    s = m @ m.T
    p0 = np.array([0.5, 0.5] + [0] * 6)
    p, q = p0, p0
    cov = np.cov(m)
    for _ in range(6):
        p = 0.15 * (s / s.sum(0)) @ p + 0.85 * p0
        q = 0.15 * cov @ q + 0.85 * p0
    got = {t.id: t.p for t in walks.restart_walk(x, walks.seeds(spark, [0, 1]), tolerance=None, steps=6).collect()}
    assert [got[i] for i in range(8)] == pytest.approx(p.tolist())
    features = spark.range(5).select(F.col("id").alias("f"))
    got = {t.id: t.p for t in walks.covariance_walk(x, features, walks.seeds(spark, [0, 1]), steps=6).collect()}
    assert [got[i] for i in range(8)] == pytest.approx(q.tolist())


def dense_matrix(df, rows, cols):
    m = np.zeros((rows, cols))
    for i, c, v in df.collect():
        m[i, c] = v
    return m


def test_svd_and_pca(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(12, 6))
    x = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(6)], "id long, f long, v double")
    u, s, v = linalg.svd(x, 3)
    uu, vv = dense_matrix(u.select("id", "component", "value"), 12, 3), dense_matrix(v.select("f", "component", "value"), 6, 3)
    _, true, vt = np.linalg.svd(m)
    assert s.tolist() == pytest.approx(true[:3].tolist())
    assert np.allclose(uu.T @ uu, np.eye(3), atol=1e-8) and np.allclose(np.abs((vv * vt[:3].T).sum(0)), 1)
    values, directions = linalg.principal_components(x, 2)
    w, e = np.linalg.eigh(np.cov(m.T))
    assert values.tolist() == pytest.approx(w[::-1][:2].tolist())
    q = linalg.subspace(x, 2, sweeps=40)
    qq = np.array([[t.q0, t.q1] for t in q.orderBy("f").collect()])
    assert np.allclose(np.abs((qq * e[:, ::-1][:, :2]).sum(0)), 1, atol=1e-3)


def test_members_and_groups_partition(spark):
    v = spark.createDataFrame([(f, c, float((f * 7 + c * 3) % 5)) for f in range(9) for c in range(4)], "f long, component int, value double")
    mean = {c: np.mean([(f * 7 + c * 3) % 5 for f in range(9)]) for c in range(4)}
    assert all(r.value >= mean[r.component] for r in linalg.members(v).collect())
    g = linalg.groups(v.withColumnRenamed("f", "id")).collect()
    assert len(g) == 9 and {r.component for r in g} <= {0, 1, 2}


def test_cp_recovers_a_low_rank_tensor(spark):
    r = np.random.default_rng(3)
    a, b, c = (r.random((n, 2)) for n in (5, 4, 3))
    x = np.einsum("ir,jr,kr->ijk", a, b, c)
    t = spark.createDataFrame([(i, j, k, float(x[i, j, k])) for i in range(5) for j in range(4) for k in range(3)], "i long, j long, k long, x double")
    factors, fit = tensors.cp(t, rank=2, sweeps=25)
    f = [np.array([list(q)[1:] for q in factors[m].orderBy(m).collect()]) for m in tensors.MODES]
    model = np.einsum("ir,jr,kr->ijk", *f)
    assert fit > 0.95 and fit == pytest.approx(1 - np.linalg.norm(x - model) / np.linalg.norm(x), abs=1e-6)


def test_lsh_finds_a_part_of_the_linear_scan(spark):
    r = np.random.default_rng(4)
    points = spark.createDataFrame([(i, [float(v) for v in r.normal(size=8)]) for i in range(200)], "id long, v array<double>")
    queries, family = points.filter("id < 5"), lsh.Family(8, 6, 2, width=2.0)
    found, exact = lsh.nearest(points, queries, family, 200).collect(), lsh.linear_scan(points, queries, 200).collect()
    distances = {(x.query, x.id): x.dist for x in exact}
    assert found and all(distances[(x.query, x.id)] == pytest.approx(x.dist) and x.id != x.query for x in found)
    assert all(x.unique_candidates <= x.overall_candidates for x in lsh.touched(points, queries, family).collect())
    assert lsh.index(points, family, 2).count() == 400
    hashed = lsh.Family(2, 1, 1, 1.0, directions=np.array([[[0.5, -1.0]]]), offsets=np.array([[0.3]]))
    assert lsh.index(spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>"), hashed).first().key == "-1"


def test_votes_ties_and_recoding(spark):
    near = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.8), (1, "a", 0.7), (1, "b", 0.6)], "id long, label string, sim double")
    assert relational.majority(near, "id", "label", "sim").first().label == "b"
    ids = spark.createDataFrame([(x,) for x in (50, 7, 7, 900, 12)], "id long")
    assert {(r.id, r.code) for r in relational.dense(ids, "id", "code", start=0).collect()} == {(7, 0), (12, 1), (50, 2), (900, 3)}
    inf = float("inf")
    assert sorted(r.x for r in relational.clamp_infinite(spark.createDataFrame([(inf,), (-inf,), (1.0,), (3.0,)], "x double"), "x").collect()) == [1, 1, 3, 3]


def test_classifiers_learn_a_simple_rule(spark):
    rows = [(i, i % 3) for i in range(90)]
    x = spark.createDataFrame([(i, c, 1.0) for i, c in rows] + [(i, 3, 0.5) for i, _ in rows], "id long, f long, v double")
    labels = spark.createDataFrame([(i, f"class{c}") for i, c in rows if i < 60], "id long, label string")
    want = {i: f"class{c}" for i, c in rows}
    assert {r.id: r.label for r in classify.tree(x, labels, min_size=2).collect()} == want
    assert {r.id: r.label for r in classify.svm(x, labels, c=10.0).collect()} == want
    assert {r.id: r.label for r in classify.nearest_vote(x, labels, 3).collect()} == {i: c for i, c in want.items() if i >= 60}
    assert len({r.fold for r in classify.folds(labels, "id").collect()}) == 5


def test_root_split_equals_exhaustive_search(spark):
    r = np.random.default_rng(5)
    v = np.where(r.random((40, 4)) < 0.7, r.integers(1, 5, (40, 4)), 0).astype(float)
    y = ((v[:, 2] >= 3) ^ (r.random(40) < 0.1)).astype(int)
    best = None
    for f in range(4):
        for t in sorted(set(v[:, f])):
            left = v[:, f] < t
            g = sum(m.sum() / 40 * (1 - sum((y[m] == c).mean() ** 2 for c in (0, 1))) for m in (left, ~left) if m.any())
            best = min(best or (9, 0, 0), (round(g, 9), f, t))
    x = spark.createDataFrame([(i, f, float(v[i, f])) for i in range(40) for f in range(4) if v[i, f]], "id long, f long, v double")
    got = classify.root_split(x, spark.createDataFrame([(i, str(y[i])) for i in range(40)], "id long, label string")).first()
    assert (round(got.gini, 9), got.f, got.threshold) == pytest.approx(best)


def test_csv_with_other_header_names(spark, tmp_path):
    (tmp_path / "tags.csv").write_text('tagId,tag\n8,"one, two"\n9,three\n')
    got = readers.read_csv(spark, str(tmp_path / "tags.csv"), "genome_tags")
    assert [tuple(r) for r in got.orderBy("tagid").collect()] == [(8, "one, two"), (9, "three")]
    assert readers.read_rows(spark, str(tmp_path / "tags.csv")).count() == 3
    assert readers.numbers(spark.createDataFrame([(" 1.5 ",), ("x",)], "a string"), "a").collect()[0].a == 1.5


def test_streams(spark, tmp_path):
    from tidewright.streaming import windows

    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, "click", 1.0) for i in range(0, 50, 5)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    for name, make in (("w", windows.event_counts), ("s", windows.sessions)):
        query = make(windows.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName(f"stream_{name}").trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert spark.table(f"stream_{name}").count() >= 0
    batch = windows.event_counts(spark.read.schema(windows.EVENTS).parquet(str(tmp_path / "in")), "30 minutes")
    assert sorted(r.n for r in batch.collect()) == [4, 6]


def test_svm_reaches_the_least_objective(spark):
    r = np.random.default_rng(6)
    x, y = r.normal(size=(60, 4)) * (r.random((60, 4)) < 0.8), r.integers(0, 3, 60)
    x[np.arange(60), y] += 1
    rows = [(int(c), [int(j) for j in np.flatnonzero(v)], [float(a) for a in v[v != 0]]) for v, c in zip(x, y, strict=True)]
    data = spark.createDataFrame(rows, "y int, js array<int>, vs array<double>").repartition(3)
    got = classify.svm_weights(data, (3, 4), c=0.1, tolerance=1e-3)
    value = lambda w: (w * w).sum() / 2 + 0.1 * classify._hinge(w, x, y, 0)[0]
    w, least = np.zeros((3, 4)), np.inf
    for t in range(4000):  # plain subgradient steps
        w = w - (w + 0.1 * classify._hinge(w, x, y, 0)[1]) / (t + 10)
        least = min(least, value(w))
    assert value(got) <= 1.01 * least


def test_cross_validation_of_a_simple_rule(spark):
    x = spark.createDataFrame([(i, i % 3, 1.0) for i in range(60)] + [(i, 3, 0.5) for i in range(60)], "id long, f long, v double")
    labels = spark.createDataFrame([(i, f"class{i % 3}") for i in range(60)], "id long, label string")
    got = classify.cross_validation(x, labels, n=3, min_size=2).collect()
    assert sum(g["size"] for g in got) == 60 and all(g.accuracy == 1 for g in got) and len(got) == 3


def test_nothing_but_the_entry_point_needs_the_training_data_operators():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in [*root.glob("tidewright/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" in path.relative_to(root).parts:
            continue
        names = [n for node in ast.walk(ast.parse(path.read_text())) for n in ([a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else [])]
        assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


@pytest.mark.parametrize("each", [1 << 18, 10])
def test_topics_of_a_large_vocabulary_stay_in_the_executors(spark, each):
    """no driver-side vocabulary; two kinds of documents with words of their own are told apart."""
    rows = spark.createDataFrame([(d, 100 * (d % 2) + (d * 7 + i * 3) % 20 + 10) for d in range(20) for i in range(12)], "d long, w long")
    terms, shares = topics.variational(rows.select("d", F.col("w").cast("string")), "d", 2, documents_each=each)
    kind = {}
    for t in terms.collect():
        kind.setdefault(int(t.word) >= 100, [0.0, 0.0])[t.topic] += t.weight
    assert sum(map(sum, kind.values())) == pytest.approx(2)
    assert kind[True].index(max(kind[True])) != kind[False].index(max(kind[False])) and max(kind[True]) > 0.9 and max(kind[False]) > 0.9
    best = {}
    for s in shares.collect():
        best.setdefault(s.d, {})[s.topic] = s.share
    assert len(best) == 20 and all(sum(v.values()) == pytest.approx(1) for v in best.values())
    assert len({(d % 2, max(v, key=v.get)) for d, v in best.items()}) == 2
    assert topics.lda(rows, "d", "w", 2, limit=10**6)[0].count() == 2 * rows.select("w").distinct().count()


@pytest.mark.parametrize("each", [100, 5])
def test_variational_topics_follow_the_plain_iteration(spark, each):
    """packed words, whose entries cross Arrow batches, give what a plain pass over all cells gives."""
    digamma = topics._digamma
    assert digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721])
    r = np.random.default_rng(3)
    rows = [(int(d), str(w)) for d, w in zip(r.integers(0, 11, 400), r.integers(0, 40, 400), strict=True)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        terms, shares = topics.variational(spark.createDataFrame(rows, "d long, w string"), "d", 2, passes=3, documents_each=each)
        got, own = {(t.word, t.topic): t.weight for t in terms.collect()}, {(t.d, t.topic): t.share for t in shares.collect()}
    finally:
        spark.conf.set(key, before)
    names, docs = sorted({w for _, w in rows}), sorted({d for d, _ in rows})
    n = np.zeros((len(docs), len(names)))
    for d, w in rows:
        n[docs.index(d), names.index(w)] += 1
    noise = spark.createDataFrame([(w,) for w in names], "w string").selectExpr("w", *[f"1 + 0.35 * (pmod(xxhash64(w, {c}, 0), 2000003) / 2000003 - 0.5) as n{c}" for c in range(2)]).collect()
    beta, theta, total = np.array([[t.n0, t.n1] for t in sorted(noise)]), np.full((len(docs), 2), 1.5), np.full(2, float(len(names)))
    for _ in range(3):
        share = np.exp(digamma(theta) - digamma(theta.sum(1, keepdims=True)))[:, None] * np.exp(digamma(beta) - digamma(total))[None]
        share *= (n / share.sum(2))[:, :, None]
        beta, theta = 0.5 + share.sum(0), 0.5 + share.sum(1)
        total = beta.sum(0)
    assert got == pytest.approx({(w, c): beta[i, c] / total[c] for i, w in enumerate(names) for c in range(2)}, abs=1e-9)
    assert own == pytest.approx({(d, c): theta[i, c] / theta[i].sum() for i, d in enumerate(docs) for c in range(2)}, abs=1e-9)


def test_recommendation_by_topics_does_not_join_all_lines_with_orders(spark, monkeypatch):
    """a user's movies are found from the user's orders."""
    from tidewright.plans import recommend
    from tidewright.sources.readers import Bed

    bed = Bed(spark, "/root/testdata/sf0.001")
    rated = bed.ratings().filter(F.col("userid") == 7).select("movieid").union(bed.tags().filter(F.col("userid") == 7).select("movieid")).distinct()
    assert {r[0] for r in rated.collect()} == {r[0] for r in bed.movies_of(7).collect()}
    monkeypatch.setattr(Bed, "_lines", None)
    found = recommend.recommend_lda(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 5 and all(t.score > 0 for t in found)


def test_scores_by_topics_are_not_rounded_to_nothing(spark, monkeypatch):
    """with a million movies a topic weight is about 1e-6, and a score its square."""
    from tidewright.plans import recommend

    def lda(rows, *_, **__):
        weights = spark.createDataFrame([(0, str(w), 1e-7 * (1 + int(w) % 7)) for w in range(1, 200)], "topic int, word string, weight double")
        return weights, None

    monkeypatch.setattr(topics, "lda", lda)
    found = recommend.recommend_lda(spark, "/root/testdata/sf0.001").collect()
    assert all(t.movieid % 7 == 6 and t.score > 0 for t in found) and len(found) == 5


def test_directions_of_a_large_vocabulary_need_no_gram_matrix(spark, monkeypatch):
    """the genre's semantics go by subspace iteration beyond GRAM_LIMIT, with the same signs."""
    from tidewright.plans import similarity

    r = np.random.default_rng(7)
    m = r.normal(size=(30, 8)) * np.array([9, 6, 4, 1, 1, 1, 1, 1])
    x = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(8)], "id long, f long, v double")
    exact = {(t.f, t.component): t.value for t in linalg.directions(x, 3).collect()}
    monkeypatch.setattr(linalg, "GRAM_LIMIT", 4)
    monkeypatch.setattr(linalg, "_gram_of_features", None)
    found = {(t.f, t.component): t.value for t in linalg.directions(x, 3, sweeps=12).collect()}
    assert found.keys() == exact.keys() and all(found[k] == pytest.approx(exact[k], abs=1e-3) for k in exact)
    monkeypatch.setattr(similarity, "_genre_actors", lambda bed, genre: x.toDF("movieid", "actorid", "tfidf"))
    assert similarity.genre_semantics(spark, "/nowhere", "actor", "pca").count() > 0


@pytest.mark.parametrize("hashed", [False, True])
def test_scans_by_blocks_keep_every_tie(spark, hashed, monkeypatch):
    """blocks instead of pairs of rows; copies tie and go by id."""
    r = np.random.default_rng(8)
    v = np.repeat(r.normal(size=(40, 8)), 3, axis=0)
    points = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v)], "id long, v array<double>")
    queries, family = points.filter("id % 10 = 0"), lsh.Family(8, 4, 2, width=2.0)
    codes = family.codes(v)
    monkeypatch.setattr(lsh._scan, "__defaults__", (None, 7))
    found = (lsh.nearest(points, queries, family, 4) if hashed else lsh.linear_scan(points, queries, 4)).collect()
    want = set()
    for q in range(0, 120, 10):
        near = [(float(np.sqrt(sum((v[q] - v[i]) ** 2))), i) for i in range(120) if i != q and (not hashed or (codes[q] == codes[i]).all(1).any())]
        want |= {(q, i) for _, i in sorted(near)[:4]}
    assert {(x.query, x.id) for x in found} == want and len(found) == len(want)
    keys = {(x.layer, x.id): x.key for x in lsh.index(points, family).collect()}
    assert all(keys[layer, i] == ",".join(map(str, codes[i, layer])) for layer in range(4) for i in range(120))
    plan = lsh.linear_scan(points, queries, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_gram_blocks_write_their_cells_once(spark):
    """no exchange holds each cell once for every other block; actors' cells go through one exchange by actor."""
    x = spark.createDataFrame([(e, f, 1.0 + e) for e in range(50) for f in range(e % 5 + 1)], "e long, f long, v double")
    found = vectors.gram_blocks(x, "e", "f", "v", block=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Generate" not in plan
    assert {(r.a1, r.a2): r.w for r in found.collect()} == {(a, b): (1.0 + a) * (1.0 + b) * (min(a % 5, b % 5) + 1) for a in range(50) for b in range(a, 50)}


def test_gram_blocks_round_whole_columns(spark):
    """F1 of round 3: q21's weights are rounded where they are made, halves away from zero; a product of 0 stays where a feature is shared."""
    x = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.25), (3, 1, -0.25), (4, 2, 0.0), (5, 2, 1.0), (6, 3, 1.0), (6, 4, 1.0), (7, 3, 1.0), (7, 4, -1.0), (8, 9, 1.25)], "e long, f long, v double")
    found = {(r.a1, r.a2): r.w for r in vectors.gram_blocks(x, "e", "f", "v", block=3, digits=1).collect()}
    same = {(1, 1): 0.3, (2, 2): 0.1, (3, 3): 0.1, (4, 4): 0.0, (5, 5): 1.0, (6, 6): 2.0, (7, 7): 2.0, (8, 8): 1.6}
    assert found == same | {(1, 2): 0.1, (1, 3): -0.1, (2, 3): -0.1, (4, 5): 0.0, (6, 7): 0.0}
    from tidewright.plans import similarity

    plan = similarity.actor_similarity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")  # no step for each row follows


def test_bounded_walk_equals_the_joins(spark):
    rng = np.random.default_rng(3)
    cells = [(int(i), int(f), float(rng.random())) for i in range(30) for f in rng.choice(9, 4, replace=False)]
    x = spark.createDataFrame(cells, "id long, f int, v double")
    rows = x.groupBy("id").agg(F.collect_list("f").alias("j"), F.collect_list("v").alias("u"))
    start = walks.seeds(spark, [0, 5])
    for how in (dict(tolerance=None, steps=4), dict(tolerance=1e-4), dict(tolerance=None, steps=3, normalize=False)):
        want = {r.id: r.p for r in walks.restart_walk(x, start, **how).collect()}
        got = {r.id: r.p for r in walks.bounded_walk(rows, 9, start, lambda j, u, sizes: u, **how).collect()}
        assert want.keys() == got.keys() and all(abs(want[i] - got[i]) < 1e-12 for i in want)


def test_walk_on_similarity_joins_no_cells_in_its_steps(spark, monkeypatch):
    from tidewright.plans import registered

    monkeypatch.setattr(walks, "apply_gram", None)
    for name in ("q23_walk_on_similarity", "q23_walk_to_convergence"):
        assert registered()[name][0](spark, "/root/testdata/sf0.001").count() == 10


def test_top_products_compares_equal_rows_once(spark):
    rng = np.random.default_rng(4)
    kinds = [{int(f): round(float(rng.random()), 3) for f in rng.choice(12, 3, replace=False)} for _ in range(12)]
    vector = {i: kinds[int(rng.integers(12))] for i in range(90)}
    x = spark.createDataFrame([(i, f, a) for i, e in vector.items() for f, a in e.items()], "id long, f long, v double")
    unknown, known = x.filter("id % 3 != 0"), x.filter("id % 3 = 0")
    got = sorted((r.id, -r.sim, r.other) for r in classify.top_products(unknown, known, 4, block=5).collect())
    want = []
    for i in (i for i in vector if i % 3):
        sims = [(i, -round(sum(a * vector[o][f] for f, a in vector[i].items() if f in vector[o]), 9), o) for o in vector if o % 3 == 0 and vector[i].keys() & vector[o].keys()]
        want += sorted(sims)[:4]
    assert [g[::2] for g in got] == [g[::2] for g in sorted(want)] and np.allclose([g[1] for g in got], [g[1] for g in sorted(want)])
    assert classify._equal_rows(classify._packed_rows(x)).count() == len({tuple(sorted(e.items())) for e in vector.values()})


@pytest.mark.parametrize("wide", [False, True])
def test_bounds_spare_products_but_lose_none(wide, monkeypatch):
    """F2 of round 3: few pairs of different rows are multiplied out, and the k first are those of all pairs, with ties, weights of 0, negative ones and rows of many features."""
    rng = np.random.default_rng(6)

    def rows(n, few, signed):
        m = np.where(rng.random((n, 550)) < few, rng.random((n, 550)) - (0.5 if signed else 0), np.nan)
        m[np.arange(n), rng.integers(0, 550, n)] = 0
        m[:: max(1, n // 3), :400] = 0.001
        m[1::7] = np.round(m[1::7], 1)  # many ties
        return m, (~np.isnan(m)).sum(1), np.nonzero(~np.isnan(m))[1] * (10**12 if wide else 1), m[~np.isnan(m)]

    for signed, few in ((False, 0.05), (True, 0.05), (True, 0.004)):
        (x, *xs), (y, *ys) = rows(60, few, signed), rows(4001, few, signed)
        asked, taken, ids = classify._Asked(np.arange(60), *xs, 5), [], 10**6 - np.arange(4001)
        if wide:
            asked.dense = None
        take = asked._take
        monkeypatch.setattr(asked, "_take", lambda i, *rest: (taken.append(len(i)), take(i, *rest)))
        for a in range(0, 4001, 1000):
            ends = np.r_[0, np.cumsum(ys[0])]
            own = slice(ends[a], ends[min(4001, a + 1000)])
            asked.meet(ids[a : a + 1000], ys[0][a : a + 1000], ys[1][own], ys[2][own])
        for i in range(60):
            shared = np.flatnonzero((~np.isnan(y[:, ~np.isnan(x[i])])).any(1))
            sims = np.round(np.nan_to_num(y[shared]) @ np.nan_to_num(x[i]), 9)
            best = shared[np.lexsort((ids[shared], -sims))[:5]]
            found = asked.sim[i] > -np.inf
            assert np.allclose(asked.sim[i][found], np.sort(-sims)[:5] * -1, atol=2e-9) and found.sum() == len(best)
            if len(set(np.round(np.sort(-sims)[:6], 7))) == 6:
                assert list(asked.other[i][found]) == list(ids[best])
        if few == 0.05 and not signed:
            assert sum(taken) < 60 * 4001 / 2


def test_subspace_by_blocks_equals_the_dense_iteration(spark, monkeypatch):
    from tidewright.operators import panels

    for name, small in (("ROWS", 8), ("CELLS", 16), ("SUMS", 50 * 4 * 8 * 3), ("HELD", 64)):
        monkeypatch.setattr(panels, name, small)
    rng = np.random.default_rng(5)
    m = np.where(rng.random((50, 30)) < 0.2, rng.random((50, 30)), 0) + np.eye(50, 30)
    m[:, :4] = np.where(rng.random((50, 4)) < 0.5, rng.random((50, 4)), 0) * [810, 270, 90, 30]
    x = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in zip(*(a.tolist() for a in np.nonzero(m)), strict=True)], "id long, f long, v double")
    q = linalg.subspace(x, 4, sweeps=4).toPandas().sort_values("f").drop(columns="f").to_numpy()
    want = np.linalg.svd(m - m.mean(0))[2][:4].T
    assert q.shape == (30, 4) and np.allclose(np.abs(q.T @ want), np.eye(4), atol=1e-3)


def test_recommenders_by_columns_equal_cosines(spark, monkeypatch):
    from tidewright.plans import recommend
    from tidewright.sources.readers import Bed

    bed = Bed(spark, "/root/testdata/sf0.001")
    rng = np.random.default_rng(6)
    ids = [r[0] for r in bed.movies().select("movieid").collect()]
    q = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in ids], "f long, q0 double, q1 double, q2 double")
    long = q.select("f", F.posexplode(F.array("q0", "q1", "q2")).alias("component", "value"))
    want, got = (f.collect() for f in (recommend._by_factors(bed, long, recommend.USER), recommend._by_columns(bed, q, 3, recommend.USER)))
    assert want == got and len(got) == 5


def test_cross_validation_makes_sparse_vectors_once(spark, monkeypatch):
    """all folds share one table of sparse vectors; each tree's answers are those of a tree fitted alone."""
    r = np.random.default_rng(11)
    x = spark.createDataFrame([(i, int(f), float(1 + (i + f) % 5)) for i in range(120) for f in r.choice(9, 3, False)], "id long, f long, v double")
    labels = spark.createDataFrame([(i, "ab"[i % 5 > 2]) for i in range(120)], "id long, label string")
    made, vectors = [], classify._vectors
    monkeypatch.setattr(classify, "_vectors", lambda *a: made.append(vectors(*a)) or made[-1])
    found = {t.fold: (t.size, t.accuracy) for t in classify.cross_validation(x, labels, n=2, min_size=2).collect()}
    assert len(made) == 1 and all(len(t.features.indices) == 3 for t in made[0].collect())
    dealt = {t.id: t.fold for t in classify.folds(labels, "id", 2).collect()}
    truth = {t.id: t.label for t in labels.collect()}
    for k in range(2):
        rest = labels.filter(F.col("id").isin([i for i, f in dealt.items() if f != k]))
        guess = {t.id: t.label for t in classify.tree(x, rest, min_size=2).collect()}
        own = [i for i, f in dealt.items() if f == k]
        assert found[k] == (len(own), pytest.approx(sum(guess[i] == truth[i] for i in own) / len(own)))


def test_bounded_covariance_walk_equals_the_joins(spark):
    """the walk over the movies' covariance needs the tags' square matrix only."""
    rng = np.random.default_rng(9)
    cells = [(int(i), int(f), float(rng.random())) for i in range(30) for f in ([*range(9)] if i == 3 else rng.choice(9, 4, replace=False))]
    x = spark.createDataFrame(cells, "id long, f int, v double")
    rows = x.groupBy("id").agg(F.collect_list("f").alias("j"), F.collect_list("v").alias("u"))
    start = walks.seeds(spark, [0, 5])
    for steps in (0, 1, 4):
        want = {r.id: r.p for r in walks.covariance_walk(x, x.select("f").distinct(), start, steps=steps).collect()}
        got = {r.id: r.p for r in walks.bounded_covariance_walk(rows, 9, start, steps=steps).collect()}
        assert want.keys() == got.keys() and len(got) == 30 and all(abs(want[i] - got[i]) < 1e-12 for i in want)


def test_all_recommenders_share_lines_and_the_iteration(spark, monkeypatch):
    """lines meet orders once for all methods, beyond the Gram matrix one subspace iteration serves SVD and PCA, and no step of a walk joins cells; the movies are those of the single methods."""
    from tidewright.plans import recommend
    from tidewright.sources.readers import Bed

    sf, names = "/root/testdata/sf0.001", ["SVD", "PCA", "LDA", "TENSORD", "PAGERANK"]
    monkeypatch.setattr(linalg, "GRAM_LIMIT", 60)
    monkeypatch.setattr(recommend, "K", 3)
    single = [recommend.METHODS[n](spark, sf).select("movieid").collect() for n in names[2:]]
    made, joins, chosen, subspace, lines = [], [], [], linalg.subspace, Bed._lines

    def few(x, k, **how):
        made.append(k)
        return subspace(x, 3, sweeps=1).selectExpr("f", *[f"q{c % 3} as q{c}" for c in range(k)])

    monkeypatch.setattr(linalg, "subspace", few)
    svd = recommend.recommend_svd(spark, sf).select("movieid").collect()
    assert recommend.recommend_pca(spark, sf).select("movieid").collect() == svd and len(made) == 2
    monkeypatch.setattr(linalg, "GRAM_LIMIT", 199)
    monkeypatch.setattr(recommend, "_many_rated", lambda bed: True)
    monkeypatch.setattr(Bed, "_lines", lambda bed: joins.append(1) or lines(bed))
    monkeypatch.setattr(recommend, "combined", lambda bed, every: chosen.extend(r[0] for r in every.collect()))
    recommend.recommend(spark, sf)
    assert len(made) == 3 and len(joins) == 1
    assert sorted(chosen) == sorted({r[0] for rows in [svd, *single] for r in rows})


@pytest.mark.parametrize("sums", [1, 1 << 28])
def test_subspace_by_parts_takes_any_number_of_columns_at_a_time(spark, monkeypatch, sums):
    """ranges of rows hold whole rows, so a sweep is one pass over the cells."""
    from tidewright.operators import panels

    for name, small in (("ROWS", 8), ("CELLS", 16), ("SUMS", sums), ("HELD", 64), ("AT_ONCE", 7), ("INNER", 8)):
        monkeypatch.setattr(panels, name, small)
    rng = np.random.default_rng(5)
    m = np.where(rng.random((50, 30)) < 0.2, rng.random((50, 30)), 0) + np.eye(50, 30)
    m[:, :4] = np.where(rng.random((50, 4)) < 0.5, rng.random((50, 4)), 0) * [810, 270, 90, 30]
    x = spark.createDataFrame([(i, f"m{j:02}", float(m[i, j])) for i, j in zip(*(a.tolist() for a in np.nonzero(m)), strict=True)], "id long, f string, v double")
    q = panels.subspace(x, 4, 3, False, 0).toPandas().sort_values("f").drop(columns="f").to_numpy()
    want = np.linalg.svd(m)[2][:4].T
    assert q.shape == (30, 4) and np.allclose(np.abs(q.T @ want), np.eye(4), atol=1e-3)
