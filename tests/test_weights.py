"""Scalar weights against hand-computed answers."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import weights as w

DAY = w.DAY_US


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_time_weights(spark):
    rows = [(0,), (DAY * 3 // 2,), (DAY * 10,)]
    low, high, us = F.lit(0), F.lit(DAY * 10), F.col("us")
    got = values(spark, rows, "us long", c=w.time_continuous(us, low, high), d=w.time_days(us, low, high), s=w.time_seconds(us, low, high))
    assert [r[0] for r in got] == [0, 0.15, 1]
    assert [r[1] for r in got] == pytest.approx([1 / 11, 2 / 11, 1])
    assert [r[2] for r in got] == pytest.approx([1 / 864001, 129601 / 864001, 1])
    assert values(spark, [(5,)], "us long", c=w.time_continuous(F.col("us"), F.lit(5), F.lit(5))) == [(1.0,)]


def test_rank_weights(spark):
    got = values(spark, [(1,), (2,), (4,)], "r int", a=w.rank_linear(F.col("r"), F.lit(1), F.lit(4)), b=w.rank_smoothed(F.col("r"), F.lit(1), F.lit(4)), c=w.rank_by_cast(F.col("r"), F.lit(3)))
    assert got == [pytest.approx((1, 1, 0.75)), pytest.approx((2 / 3, 0.75, 0.5)), pytest.approx((0, 0.25, 0))]
    assert values(spark, [(3,)], "r int", a=w.rank_linear(F.col("r"), F.lit(3), F.lit(3)), b=w.rank_smoothed(F.col("r"), F.lit(3), F.lit(3))) == [(1, 1)]


def test_rounding_and_truncation(spark):
    assert values(spark, [(0.12345,)], "x double", a=w.even4(F.col("x"))) == [(0.1234,)]
    assert values(spark, [(-1.7,)], "x double", a=F.col("x").cast("long")) == [(-1,)]


def test_discrimination(spark):
    c = F.lit
    got = values(spark, [(1,)], "i int", a=w.p_diff1(c(2), c(3), c(3), c(5)), b=w.p_diff2(c(2), c(3), c(3), c(5)), n=w.p_diff2(c(1), c(3), c(3), c(5)))[0]
    assert got[0] == pytest.approx(0.056643, abs=1e-6) and got[1] == pytest.approx(-0.405465, abs=1e-6) and got[2] is None


def test_relevance(spark):
    d = lambda x: F.lit(float(x))
    got = values(spark, [(1,)], "i int", a=w.relevance(d(2), d(2), d(3), d(10)), b=w.relevance_literal(d(2), d(2), d(3), d(10)), z=w.relevance(d(0), d(2), d(3), d(10)))[0]
    assert got == (pytest.approx(7.146128, abs=1e-6), pytest.approx(1.322219, abs=1e-6), 0)


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert values(spark, [(1,)], "i int", d=w.dot(a, b), e=w.distance(a, b)) == [(16.0, 5.0)]
    assert math.isclose(values(spark, [(1,)], "i int", d=w.log10_ratio(F.lit(100), F.lit(10)))[0][0], 1)
