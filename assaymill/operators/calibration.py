"""Reliability, calibration error and temperature scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.config import CONFOUND_NOTE, DEFAULTS, NO_PROBABILITY
from assaymill.functions import prob
from assaymill.functions.gates import bin_index
from assaymill.operators.agreement import POOLED, grouped
from assaymill.operators.clean import finite_rows


def reliability(
    df: DataFrame,
    confidence: str,
    correct: str,
    by: Sequence[str] = (),
    pooled: bool = False,
    n_bins: int = DEFAULTS.calibration_bins,
) -> DataFrame:
    """Mean confidence and accuracy per non-empty bin.

    Rows are reduced to sums per group and bin first; the pooled curve adds
    those sums up.
    """
    hit = F.col(correct).cast("double")
    sums = (
        finite_rows(df, confidence)
        .where(hit.isNotNull())
        .groupBy(*by, bin_index(F.col(confidence), n_bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("sc"), F.sum(hit).alias("sh"))
    )
    if by and pooled:
        sums = _pooled_sums(sums, by)
    return sums.select(
        *by, "bin", "n", (F.col("sc") / F.col("n")).alias("confidence"), (F.col("sh") / F.col("n")).alias("accuracy")
    )


def _pooled_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [F.col(b) for b in by]
    bin_ = F.col("bin")
    out = sums.groupingSets([[*keys, bin_], [bin_]], *keys, bin_).agg(
        F.grouping(by[0]).alias("_all"),
        F.sum("n").alias("n"),
        F.sum("sc").alias("sc"),
        F.sum("sh").alias("sh"),
    )
    named = {b: F.when(F.col("_all") == 1, POOLED).otherwise(F.col(b).cast("string")) for b in by}
    return out.withColumns(named).drop("_all")


def calibration_error(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ECE from a reliability curve."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return grouped(curve, by, False, F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, confidence: str, correct: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(confidence) - F.col(correct).cast("double")
    return grouped(finite_rows(df, confidence), by, False, F.avg(d * d).alias("brier"))


def site_calibration(
    df: DataFrame, confidence: str | None, correct: str | None, site: str, n_bins: int = DEFAULTS.calibration_bins
) -> DataFrame:
    """ECE per site and pooled, with the widest gap between sites.

    The gap needs two sites. Without a probability there is one row that says
    why. The confound note travels with every row.
    """
    if confidence is None or correct is None:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(POOLED).alias(site),
            "n",
            F.lit(None).cast("double").alias("ece"),
            F.lit(None).cast("double").alias("max_ece_gap"),
            F.lit(False).alias("available"),
            F.lit(NO_PROBABILITY).alias("reason"),
            F.lit(CONFOUND_NOTE).alias("note"),
        )
    own = reliability(df, confidence, correct, [site], n_bins=n_bins)
    # The gap is taken before the pooled row joins, so a site of any name counts.
    per_site = calibration_error(own, [site])
    gap = per_site.agg(F.when(F.count("ece") >= 2, F.max("ece") - F.min("ece"))).scalar()
    ece = per_site.unionByName(calibration_error(_over_sites(own, [], site), [site]))
    return ece.withColumns(
        {
            "max_ece_gap": gap,
            "available": F.lit(True),
            "reason": F.lit(None).cast("string"),
            "note": F.lit(CONFOUND_NOTE),
        }
    )


def _over_sites(own: DataFrame, keys: Sequence[str], site: str) -> DataFrame:
    """Reliability bins of all sites together, from those of each."""
    sums = own.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n_"),
        (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("confidence"),
        (F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("accuracy"),
    )
    return sums.withColumnRenamed("n_", "n").withColumn(site, F.lit(POOLED))


def site_calibration_by(
    df: DataFrame, confidence: str, correct: str, site: str, by: Sequence[str], n_bins: int = DEFAULTS.calibration_bins
) -> DataFrame:
    """The same audit for many heads at once: per site and pooled inside each."""
    keys = list(by)
    own = reliability(df, confidence, correct, [*keys, site], n_bins=n_bins)
    total = _over_sites(own, keys, site)
    per_site = calibration_error(own, [*keys, site])
    gaps = per_site.groupBy(*keys).agg(
        F.when(F.count("ece") >= 2, F.max("ece") - F.min("ece")).alias("max_ece_gap")
    )
    rows = per_site.unionByName(calibration_error(total, [*keys, site]))
    return rows.join(gaps, keys, "left").withColumn("note", F.lit(CONFOUND_NOTE))


@dataclass(frozen=True)
class ValidationSplit:
    """Rows of the validation split and no other; the only input of a fit."""

    rows: DataFrame

    @classmethod
    def of(cls, df: DataFrame, split: str = "split") -> "ValidationSplit":
        return cls(df.where(F.col(split) == "val"))


def temperature_grid(n_grid: int = 60) -> list[float]:
    return [float(t) for t in np.linspace(0.25, 5.0, n_grid)]


def temperature_curve(val: ValidationSplit, logits: str, target: str, k: int, n_grid: int = 60) -> DataFrame:
    """Mean negative log-likelihood at every temperature of the grid.

    The grid is a literal array, exploded and averaged on the map side: the
    shuffle carries one buffer per temperature and task.
    """
    if not isinstance(val, ValidationSplit):
        raise TypeError("temperatures are fitted on a ValidationSplit only")
    rows = val.rows.withColumn("_top", F.array_max(logits))
    rows = rows.select(
        F.array(*[z - F.col("_top") for z in prob.elements(logits, k)]).alias("d"), F.col(target).alias("y")
    )
    grid = F.array(*[F.lit(t) for t in temperature_grid(n_grid)])
    rows = rows.select("d", F.col("d")[F.col("y")].alias("own"), F.explode(grid).alias("temperature"))
    t = F.col("temperature")
    mass = prob.total([F.exp(d / t) for d in prob.elements("d", k)])
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(prob.MIN_PROBABILITY), F.exp(F.col("own") / t) / mass))
    return rows.groupBy("temperature").agg(F.avg(-F.ln(clipped)).alias("nll"))


def temperature_scale(val: ValidationSplit, logits: str, target: str, k: int, n_grid: int = 60) -> DataFrame:
    """Best temperature and the calibration error before and after it."""
    curve = temperature_curve(val, logits, target, k, n_grid)
    best = curve.agg(F.min_by("temperature", F.struct("nll", "temperature"))).scalar()
    rows = prob.softmax(val.rows, logits, "_p1")
    rows = prob.softmax(rows, logits, "_pt", best)
    pair = rows.select(
        (prob.argmax(logits) == F.col(target)).alias("hit"),
        F.stack(F.lit(2), F.lit("before"), F.array_max("_p1"), F.lit("after"), F.array_max("_pt")).alias("stage", "conf"),
    )
    ece = calibration_error(reliability(pair, "conf", "hit", ["stage"]), ["stage"])
    return ece.agg(
        F.max(F.when(F.col("stage") == "before", F.col("ece"))).alias("ece_before"),
        F.max(F.when(F.col("stage") == "after", F.col("ece"))).alias("ece_after"),
    ).select(best.alias("temperature"), "ece_before", "ece_after")
