"""Skin-tone angle and pigment proxy (Del Bino et al., 2007)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lower bounds of the typology bands, lightest first
ITA_BANDS = (
    (55.0, "very_light"),
    (41.0, "light"),
    (28.0, "intermediate"),
    (10.0, "tan"),
    (-30.0, "brown"),
)
PIGMENT_BANDS = ((0.25, "low"), (0.5, "medium"))
PIGMENT_OFFSET = 5.0
PIGMENT_RANGE = 35.0


def ita_angle(lightness: Column, b_star: Column) -> Column:
    return F.degrees(F.atan2(lightness - F.lit(50.0), b_star))


def ita_band(angle: Column) -> Column:
    chain = F.when(angle.isNull() | F.isnan(angle), "unknown")
    for floor, name in ITA_BANDS:
        chain = chain.when(angle >= floor, name)
    return chain.otherwise("dark")


def pigment_score(b_star: Column) -> Column:
    raw = (b_star - PIGMENT_OFFSET) / PIGMENT_RANGE
    return F.when(b_star.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def pigment_band(score: Column) -> Column:
    chain = F.when(score.isNull() | F.isnan(score), "unknown")
    for ceiling, name in PIGMENT_BANDS:
        chain = chain.when(score < ceiling, name)
    return chain.otherwise("high")
