"""Binning, abstention and interval expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from assaymill.config import DEFAULTS, Z_INTERVAL


def inner_edges(n_bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]


def bin_index(value: Column, n_bins: int = DEFAULTS.calibration_bins) -> Column:
    """Equal-width bin on [0, 1]; a value on an edge belongs to the upper bin.

    Counts the edges passed: ``floor(value * n)`` puts 0.3 into the wrong bin.
    """
    passed = [(value >= F.lit(e)).cast("int") for e in inner_edges(n_bins)]
    return reduce(lambda a, b: a + b, passed, F.when(value.isNotNull(), F.lit(0)))


def should_abstain(sigma: Column, threshold: Column, quality: Column, floor: float = DEFAULTS.quality_abstain) -> Column:
    unusable = sigma.isNull() | F.isnan(sigma) | (F.abs(sigma) == float("inf"))
    return F.coalesce(unusable | (sigma > threshold) | (F.coalesce(quality, F.lit(1.0)) < floor), F.lit(True))


def interval(value: Column, sigma: Column, validated: Column | None = None, z: float = Z_INTERVAL) -> Column:
    """Symmetric interval; a validated spread is preferred to the model's own."""
    s = sigma if validated is None else F.coalesce(validated, sigma)
    return F.struct((value - z * s).alias("lo"), (value + z * s).alias("hi"), s.alias("sigma"))
