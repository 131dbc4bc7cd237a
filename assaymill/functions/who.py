"""Severity bands and cut-offs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS, SEVERITY_CLASSES


def is_male(sex: Column) -> Column:
    return F.coalesce(F.upper(sex).startswith("M"), F.lit(False))


def sex_cutoff(sex: Column, cfg: AuditConfig = DEFAULTS) -> Column:
    """Per-row cut-off: one for men, another for everybody else."""
    return F.when(is_male(sex), F.lit(cfg.cut_male)).otherwise(F.lit(cfg.cut_other))


def severity_band(value: Column, sex: Column, cfg: AuditConfig = DEFAULTS) -> Column:
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value < cfg.cut_severe, "severe")
        .when(value < cfg.cut_moderate, "moderate")
        .when(value < sex_cutoff(sex, cfg), "mild")
        .otherwise("normal")
    )


def severity_index(band: Column) -> Column:
    """Class number of a band, in the order of ``SEVERITY_CLASSES``."""
    names = F.array(*[F.lit(b) for b in SEVERITY_CLASSES])
    return (F.array_position(names, band) - 1).cast("int")


def client_band(value: Column, cfg: AuditConfig = DEFAULTS) -> Column:
    """The band the field client shows: one cut-off for everybody."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value >= cfg.cut_other, "within_range")
        .when(value >= cfg.cut_moderate, "mild")
        .when(value >= cfg.cut_severe, "moderate")
        .otherwise("severe")
    )
