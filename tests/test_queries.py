"""Registered queries against their DuckDB twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tidewright.plans import registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
TWINS = {n: s for n, (_, s) in registered().items() if s}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    df = registered()[name][0](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.execute(TWINS[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", ["q16_genre_tag_svd", "q17_genre_tag_lda", "q26_cp_actor_movie_year", "q28_recommend_svd", "q30_recommend_lda", "q31_recommend_cp", "q41_tree"])
def test_others_give_rows(spark, name):
    assert registered()[name][0](spark, FOLDER).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["actorid", "tagid", "tfidf"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_walk_needs_no_actor_pairs(spark):
    plan = registered()["q18_all_actor_tfidf"][0](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "l_extendedprice" not in plan


def test_hashed_search_recalls_nine_in_ten(spark):
    found, exact = ({(r.query, r.id) for r in registered()[q][0](spark, FOLDER).collect()} for q in ("q38_lsh_nearest", "q38_linear_nearest"))
    assert len(exact) == 125 and len(found & exact) >= 0.9 * len(exact)


def test_svm_learns_its_labels(spark):
    from tidewright.plans.recommend import _classified_input

    guess = {r.movieid: r.label for r in registered()["q42_svm"][0](spark, FOLDER).collect()}
    labels = _classified_input(spark, FOLDER)[1].collect()
    common = max(sum(a.label == b.label for b in labels) for a in labels)
    assert sum(guess.get(r.id) == r.label for r in labels) >= common


def test_singular_values_equal_numpy(spark):
    import numpy as np

    x = registered()["q25_all_movie_tags_continuous"][0](spark, FOLDER).collect()
    m = np.zeros((1 + max(r.movieid for r in x), 1 + max(r.tagid for r in x)))
    for r in x:
        m[r.movieid, r.tagid] = r.tfidf
    got = [r.singular for r in registered()["q25_all_movie_tags_svd"][0](spark, FOLDER).orderBy("component").collect()]
    assert np.allclose(got, np.linalg.svd(m, compute_uv=False)[: len(got)], atol=2e-6) and len(got) > 50
