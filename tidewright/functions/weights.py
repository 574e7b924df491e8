"""Scalar weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b; where b is 0 the other value."""
    return F.when(b == 0, F.lit(otherwise).cast("double")).otherwise(a.cast("double") / F.when(b != 0, b).cast("double"))


def time_continuous(us: Column, low: Column, high: Column) -> Column:
    """TSW-c: from 0 for the oldest to 1 for the newest; 1 if there is one time only."""
    return _ratio(us - low, high - low, 1.0)


def time_days(us: Column, low: Column, high: Column) -> Column:
    """TSW-d: whole days since the oldest plus 1, over the same of the newest."""
    days = lambda x: F.floor((x - low) / F.lit(float(DAY_US))) + 1
    return days(us).cast("double") / days(high).cast("double")


def time_seconds(us: Column, low: Column, high: Column) -> Column:
    """TSW-s: whole seconds since the oldest plus 1, over the same of the newest."""
    seconds = lambda x: F.floor((x - low) / F.lit(1e6)) + 1
    return seconds(us).cast("double") / seconds(high).cast("double")


def rank_linear(rank: Column, low: Column, high: Column) -> Column:
    """RW-1: 1 for the first-billed to 0 for the last; 1 for a cast of one rank."""
    return F.when(high > 1, F.coalesce(1 - _ratio(rank - low, high - low), F.lit(1.0))).otherwise(F.lit(1.0))


def rank_smoothed(rank: Column, low: Column, high: Column) -> Column:
    """RW-2: never 0."""
    return (1 + high - rank).cast("double") / (1 + high - low).cast("double")


def rank_by_cast(rank: Column, cast_size: Column) -> Column:
    """RW-3: 1 - rank / (cast size + 1)."""
    return 1 - rank.cast("double") / (cast_size + 1).cast("double")


def even4(x: Column) -> Column:
    """Four decimals, half to even."""
    return F.bround(x, 4)


def log10_ratio(n: Column, k: Column) -> Column:
    return F.log10(n.cast("double") / k.cast("double"))


def _odds(x: Column, y: Column) -> Column:
    """x (1 - y) / (y (1 - x)), or null where it has no logarithm."""
    top, bottom = x * (1 - y), y * (1 - x)
    return F.when((top > 0) & (bottom > 0), top / F.when(bottom > 0, bottom))


def p_diff1(r: Column, big_r: Column, m: Column, big_m: Column) -> Column:
    share = m.cast("double") / big_m
    x, y = (r + share) / (big_r + 1), (m - r + share) / (big_m - big_r + 1)
    return F.ln(_odds(x, y)) * (x - y)


def p_diff2(r: Column, big_r: Column, m: Column, big_m: Column) -> Column:
    x = (big_r - r).cast("double") / (big_r + 1)
    y = ((big_m - m) - (big_r - r)).cast("double") / (big_m - big_r + 1)
    return F.ln(_odds(x, y))


def p_diff_product(r: Column, big_r: Column, m: Column, big_m: Column) -> Column:
    """The variant that takes the logarithm of the whole product; null where x = y or the product has none."""
    share = m.cast("double") / big_m
    x, y = (r + share) / (big_r + 1), (m - r + share) / (big_m - big_r + 1)
    product = _odds(x, y) * F.abs(x - y)
    return F.when(product > 0, F.ln(F.when(product > 0, product)))


def relevance(r: Column, big_r: Column, n: Column, big_n: Column, eps: float = 1e-6) -> Column:
    """The weight of a tag that r of R relevant movies and n of N movies carry; 0 where no relevant one does."""
    e = F.lit(eps)
    odds = ((r + e) / (big_r - r + e)) / ((n - r + e) / (big_n - big_r - n + r + e))
    return F.when(r == 0, F.lit(0.0)).otherwise(F.log10(odds))


def relevance_literal(r: Column, big_r: Column, n: Column, big_n: Column, eps: float = 1e-6) -> Column:
    """The same with r + (eps / ...) above, as it is easily written by mistake."""
    e = F.lit(eps)
    return F.when(r == 0, F.lit(0.0)).otherwise(F.log10((r + e / (big_r - r + e)) / ((n - r + e) / (big_n - big_r - n + r + e))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
