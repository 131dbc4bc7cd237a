"""Selective prediction: what is the error of the most certain share?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.operators.clean import finite_rows
from assaymill.operators.ordered import ROWS_PER_BUCKET, rows_at


def fractions(n_points: int = 20) -> list[float]:
    return [float(f) for f in np.linspace(1.0, 0.1, n_points)]


def risk_coverage(
    df: DataFrame,
    uncertainty: str,
    row_id: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    by: Sequence[str] = (),
    n_points: int = 20,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mean error of the k most certain rows, for ``n_points`` shares per group.

    k is the share of n rounded half to even, at least one; equal uncertainty is
    ordered by the md5 of the row id.
    """
    rows = finite_rows(df, truth, pred, uncertainty).select(
        *by, row_id, uncertainty, F.abs(F.col(pred) - F.col(truth)).alias("err")
    )

    def wanted(n: Column) -> list[tuple[Column, Column]]:
        return [
            (F.lit(i), F.greatest(F.lit(1.0), F.rint(F.lit(f) * n))) for i, f in enumerate(fractions(n_points))
        ]

    found = rows_at(rows, uncertainty, row_id, wanted, by, ["err"], rows_per_bucket)
    return found.select(
        *by,
        F.col("label").alias("point"),
        "n",
        F.col("position").alias("k"),
        F.round(F.col("position") / F.col("n"), 4).alias("coverage"),
        (F.col("err_upto") / F.col("position")).alias("mae"),
        F.col("value").alias("threshold"),
    )


def at_coverages(curve: DataFrame, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The curve point nearest to each requested coverage, the first on a tie."""
    asked = curve.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    near = F.struct(F.abs(F.col("coverage") - F.col("target")), F.col("point"))
    out = asked.groupBy(*by, "target").agg(
        F.min_by(F.struct("coverage", "mae", "threshold", "k", "n"), near).alias("p")
    )
    return out.select(*by, "target", "p.coverage", "p.mae", "p.threshold", (1.0 - F.col("p.coverage")).alias("rejected"))


def abstention_threshold(curve: DataFrame, target: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the first point at or below a coverage, else of the last."""
    hit = F.col("coverage") <= target
    first = F.min_by(F.when(hit, F.col("threshold")), F.when(hit, F.col("point")))
    value = F.coalesce(first, F.max_by("threshold", "point"), F.lit(float("inf"))).alias("threshold")
    return curve.groupBy(*by).agg(value) if by else curve.agg(value)
