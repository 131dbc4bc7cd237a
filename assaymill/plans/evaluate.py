"""The whole audit of a prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.operators import agreement as A
from assaymill.operators import calibration as C
from assaymill.operators import coverage as V
from assaymill.operators import fairness as E
from assaymill.operators import screening as S
from assaymill.operators.clean import finite_rows
from assaymill.operators.ordered import spearman
from assaymill.session import written
from assaymill.sources.predictions import named_predictions

MIN_COVARIATE_ROWS = 5
COVERAGES = (1.0, 0.9, 0.8, 0.7)


def evaluate(df: DataFrame, row_id: str = "id", cfg: AuditConfig = DEFAULTS) -> dict[str, DataFrame]:
    """Agreement, screening, fairness, calibration and coverage of a table.

    Every section is a small aggregate over a few columns, some of them in several
    passes, so the columns in use are written once and then scanned narrowly.
    Sections whose column is absent say so.
    """
    named = finite_rows(named_predictions(df), "y_true", "y_pred")
    rows = written(named.select(*[c for c in (row_id, "site", "sex", "y_true", "y_pred", "ita", "confidence") if c in named.columns]))
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    scored = rows.withColumn("correct", error <= cfg.agreement_margin)
    has = set(rows.columns)
    out = {
        "regression": A.agreement(rows, by=["site"], pooled=True),
        "rank_correlation": spearman(rows, "y_true", "y_pred", row_id),
        "screening": S.screening(rows, by=["site"], pooled=True, cfg=cfg),
        "calibration": C.site_calibration(
            scored, *(("confidence", "correct") if "confidence" in has else (None, None)), "site", cfg.calibration_bins
        ),
    }
    if "ita" in has:
        fit = E.bias_slope(rows, "ita", cfg=cfg)
        out["fairness"] = fit.withColumn("available", F.col("n") >= MIN_COVARIATE_ROWS)
    if "confidence" in has:
        uncertain = rows.withColumn("_unc", 1.0 - F.col("confidence"))
        out["coverage"] = V.at_coverages(V.risk_coverage(uncertain, "_unc", row_id), COVERAGES)
    return out


def long_form(results: dict[str, DataFrame]) -> DataFrame:
    """All sections as (section, grp, metric, value)."""
    spec = {
        "regression": (F.col("site"), ("n", "mae", "rmse", "r2", "bias", "loa_lower", "loa_upper")),
        "rank_correlation": (F.lit("pooled"), ("spearman_rho",)),
        "screening": (F.concat_ws("/", "site", "band"), ("tp", "fn", "fp", "tn", "sensitivity", "specificity")),
        "calibration": (F.col("site"), ("ece",)),
        "fairness": (F.lit("pooled"), ("slope", "se", "r2")),
        "coverage": (F.col("target").cast("string"), ("coverage", "mae")),
    }
    parts = []
    for section, (group, metrics) in spec.items():
        if section in results:
            pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
            parts.append(results[section].select(F.lit(section).alias("section"), group.alias("grp"), F.inline(F.array(*pairs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
