import os

import pytest

from tidewright.api import Engine

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, FOLDER)


def test_vectors(engine):
    for tf in (engine.actor(7).tf(), engine.genre("PROMO").tf(), engine.user(7).tf()):
        assert sum(r.tf for r in tf.collect()) == pytest.approx(1, abs=1e-3)
    assert all(r.tfidf >= 0 for r in engine.actor(7).tfidf(by_cast=True).collect())
    assert engine.tagged(engine.user(7).tfidf()).columns == ["tagid", "tag", "tfidf"]
    fixed = {r.tagid: r.tfidf for r in engine.actor(7).tfidf(by_cast=True, documents=27279).collect()}
    assert fixed and min(fixed.values()) > 0


def test_discrimination_and_search(engine):
    g = engine.genre("PROMO")
    assert g.tfidf_diff("ECONOMY").count() and g.p_diff1("ECONOMY").count() and g.p_diff2("ECONOMY").count()
    assert engine.actor(7).similar(3).count() == 3 and engine.movie(42).related_actors(4).count() == 4
    assert engine.user(7).recommend("PAGERANK").count() == 5 and engine.user(7).recommend(relevant=(2, 3)).count() == 5


def test_neighbours(engine):
    n = engine.neighbours(6, 3)
    assert n.query([0, 20], 5).count() <= 10 and n.index(2).count() == 2 * n.points.count() and n.touched([0]).count() <= 1 and n.feedback([0, 20], 5).count() <= 5
