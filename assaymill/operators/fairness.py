"""Does the error depend on a measured covariate?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS, Z_INTERVAL
from assaymill.functions.student import t_critical, t_pvalue
from assaymill.operators.agreement import FLAT, grouped
from assaymill.operators.clean import finite_rows


def least_squares(df: DataFrame, y: Column, x: str, needed: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, r², its standard error and n, per group.

    Fewer than three rows give NULL; a flat covariate gives slope zero.
    """
    rows = finite_rows(df, *needed).withColumn("_y", y)
    yy, xx = F.col("_y"), F.col(x)
    moments = grouped(
        rows,
        by,
        False,
        F.count(xx).alias("n"),
        F.regr_sxx(yy, xx).alias("sxx"),
        F.regr_syy(yy, xx).alias("syy"),
        F.regr_sxy(yy, xx).alias("sxy"),
        F.avg(xx).alias("mx"),
        F.avg(yy).alias("my"),
    )
    n, sxx, syy, sxy = (F.col(c) for c in ("n", "sxx", "syy", "sxy"))
    flat = sxx < FLAT
    slope = F.when(n < 3, F.lit(None)).when(flat, F.lit(0.0)).otherwise(sxy / sxx)
    rss = F.greatest(syy - slope * sxy, F.lit(0.0))
    return moments.select(
        *by,
        "n",
        slope.alias("slope"),
        F.when(n >= 3, F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.when(n < 3, F.lit(None)).when(flat | (syy <= FLAT), F.lit(0.0)).otherwise(1.0 - rss / syy).alias("r2"),
        F.when(n < 3, F.lit(None)).when(flat, F.lit(0.0)).otherwise(F.sqrt(rss / (n - 2) / sxx)).alias("se"),
        (flat & (n >= 3)).alias("flat"),
    )


def with_interval(fit: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Student t interval of the slope and the two-sided p value."""
    dof = (F.col("n") - 2).cast("double")
    t = F.coalesce(t_critical(confidence)(dof), F.lit(Z_INTERVAL))
    half = t * F.col("se")
    stat = F.when(F.col("se") > FLAT, F.abs(F.col("slope") / F.col("se")))
    return fit.withColumns(
        {
            "ci_low": F.col("slope") - half,
            "ci_high": F.col("slope") + half,
            "p_value": F.when(F.col("flat"), F.lit(1.0)).otherwise(F.nanvl(t_pvalue(stat, dof), F.lit(None))),
        }
    )


def gate(fit: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Three words: supported, not_supported or underpowered."""
    excludes_zero = F.col("ci_low") * F.col("ci_high") > 0
    verdict = (
        F.when(F.col("slope").isNull() | (F.col("n") < cfg.min_n), "underpowered")
        .when(excludes_zero & (F.abs("slope") >= cfg.min_abs_slope), "supported")
        .otherwise("not_supported")
    )
    return fit.withColumn("verdict", verdict).drop("flat")


def bias_slope(
    df: DataFrame,
    covariate: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    by: Sequence[str] = (),
    confidence: float = 0.95,
    cfg: AuditConfig = DEFAULTS,
) -> DataFrame:
    fit = least_squares(df, F.col(pred) - F.col(truth), covariate, [truth, pred, covariate], by)
    return gate(with_interval(fit, confidence), cfg)


def calibration_slope(
    df: DataFrame,
    covariate: str,
    confidence_column: str,
    correct: str,
    by: Sequence[str] = (),
    cfg: AuditConfig = DEFAULTS,
) -> DataFrame:
    """The same regression on confidence minus correctness."""
    y = F.col(confidence_column) - F.col(correct).cast("double")
    fit = least_squares(df, y, covariate, [confidence_column, covariate], by)
    return gate(with_interval(fit), cfg).withColumn(
        "hypothesis", F.lit(f"calibration error is associated with {covariate}")
    )
