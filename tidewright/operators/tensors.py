"""CP decomposition of a sparse three-way tensor (i, j, k, x) by alternating least squares.

The tensor stays in coordinate form and each factor is a DataFrame of one row per index, so a sweep is three joins and
aggregations; only rank x rank matrices reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import written

MODES = ("i", "j", "k")


def _columns(mode: str, rank: int) -> list[str]:
    return [f"{mode}{r}" for r in range(rank)]


def _gram(factor: DataFrame, mode: str, rank: int) -> np.ndarray:
    c = _columns(mode, rank)
    row = factor.agg(*[F.sum(F.col(a) * F.col(b)) for a in c for b in c]).first()
    return np.array([v or 0.0 for v in row], float).reshape(rank, rank)


def _start(tensor: DataFrame, mode: str, rank: int, seed: int) -> DataFrame:
    """Uniform numbers by a hash of the index, so that a lost partition is made again alike."""
    ids = tensor.select(mode).distinct()
    return ids.select(mode, *[((F.pmod(F.xxhash64(F.col(mode), F.lit(f"{mode}{r}/{seed}")), F.lit(1_000_003)) + 1) / 1_000_004).alias(c) for r, c in enumerate(_columns(mode, rank))])


def cp(tensor: DataFrame, rank: int = 5, sweeps: int = 25, seed: int = 0, tolerance: float = 1e-3) -> tuple[dict[str, DataFrame], float]:
    """(factors by mode: the index and rank columns, fit = 1 - |X - model| / |X|). Ends when a sweep raises the fit by less than the tolerance."""
    t = written(tensor.select(*MODES, F.col("x").cast("double").alias("x")), "tensor")
    factors = {m: written(_start(t, m, rank, seed), f"factor-{m}") for m in MODES}
    grams = {m: _gram(factors[m], m, rank) for m in MODES}
    norm2 = t.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    inner, fit = 0.0, 0.0
    for _ in range(sweeps):
        for m in MODES:
            a, b = [o for o in MODES if o != m]
            inverse = np.linalg.pinv(grams[a] * grams[b])
            parts = t.join(factors[a], a).join(factors[b], b).groupBy(m).agg(*[F.sum(F.col("x") * F.col(f"{a}{r}") * F.col(f"{b}{r}")).alias(f"_{r}") for r in range(rank)])
            new = parts.select(m, *[sum((F.col(f"_{q}") * float(inverse[q, r]) for q in range(rank)), F.lit(0.0)).alias(f"{m}{r}") for r in range(rank)], *[f"_{r}" for r in range(rank)])
            new = written(new, f"factor-{m}")
            inner = new.agg(sum((F.sum(F.col(f"_{r}") * F.col(f"{m}{r}")) for r in range(rank)), F.lit(0.0))).first()[0] or 0.0
            factors[m] = new.select(m, *_columns(m, rank))
            grams[m] = _gram(factors[m], m, rank)
        model2 = float((grams["i"] * grams["j"] * grams["k"]).sum())
        before, fit = fit, 1 - (max(0.0, norm2 - 2 * inner + model2) / norm2) ** 0.5 if norm2 else 1.0
        if abs(fit - before) < tolerance:
            break
    return factors, fit


def long(factor: DataFrame, mode: str, rank: int) -> DataFrame:
    """The factor as id, component, value."""
    each = F.array(*[F.struct(F.lit(r).alias("component"), F.col(c).alias("value")) for r, c in enumerate(_columns(mode, rank))])
    return factor.select(F.col(mode).alias("id"), F.explode(each).alias("e")).select("id", "e.component", "e.value")
