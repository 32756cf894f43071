"""Intervals and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
RESAMPLES = 2000
ALPHA = 0.05


def wilson(hits: Column, n: Column) -> Column:
    """struct(lo, hi): the 95 % score interval of hits of n, within [0, 1]; (0, 0) for n = 0."""
    x, m = hits.cast("double"), n.cast("double")
    p = x / F.when(m > 0, m)
    denominator = 1 + Z * Z / m
    centre = (p + Z * Z / (2 * m)) / denominator
    margin = Z / denominator * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))
    lo = F.when(m > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(F.lit(0.0))
    hi = F.when(m > 0, F.least(F.lit(1.0), centre + margin)).otherwise(F.lit(0.0))
    safe = F.when(m > 0, F.struct(lo.alias("lo"), hi.alias("hi")))
    return F.coalesce(safe, F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))


def bootstrap_interval(values: np.ndarray, resamples: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> tuple[float, float]:
    """Percentile interval of resampled means, drawn in blocks so that memory stays bounded."""
    v = np.asarray(values, float)
    if not len(v):
        return 0.0, 0.0
    draw, means = np.random.default_rng(seed), []
    step = max(1, 4_000_000 // len(v))
    for at in range(0, resamples, step):
        rows = min(step, resamples - at)
        means.append(v[draw.integers(0, len(v), size=(rows, len(v)))].mean(axis=1))
    lo, hi = np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2])
    return float(lo), float(hi)
