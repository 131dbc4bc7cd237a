"""Screening confusion cells: low is positive, strictly below the cut-off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.functions.who import sex_cutoff
from assaymill.operators.agreement import grouped
from assaymill.operators.clean import finite_rows

CELLS = ("tp", "fn", "fp", "tn")


def bands(sex: str, cfg: AuditConfig = DEFAULTS) -> list[tuple[str, Column, float | None]]:
    """The three questions: name, cut-off per row, and the number if it is one."""
    return [
        ("anaemia", sex_cutoff(F.col(sex), cfg), None),
        ("moderate_or_worse", F.lit(cfg.cut_moderate), cfg.cut_moderate),
        ("severe", F.lit(cfg.cut_severe), cfg.cut_severe),
    ]


def _counts(t: Column, p: Column, cut: Column) -> dict[str, Column]:
    positive, called = t < cut, p < cut
    return {
        "tp": F.count_if(positive & called),
        "fn": F.count_if(positive & ~called),
        "fp": F.count_if(~positive & called),
        "tn": F.count_if(~positive & ~called),
    }


def with_rates(cells: DataFrame, min_n: int = DEFAULTS.min_n) -> DataFrame:
    """Totals, rates (NULL without a denominator) and the verdict of a cell."""
    tp, fn, fp, tn = (F.col(c) for c in CELLS)
    n, positives, negatives = tp + fn + fp + tn, tp + fn, fp + tn
    return cells.withColumns(
        {
            "n": n,
            "positives": positives,
            "sensitivity": F.try_divide(tp, positives),
            "specificity": F.try_divide(tn, negatives),
            "ppv": F.try_divide(tp, tp + fp),
            "npv": F.try_divide(tn, tn + fn),
            "verdict": F.when(n == 0, "not_computable")
            .when(n < min_n, "underpowered")
            .when((positives == 0) | (negatives == 0), "not_computable")
            .otherwise("ok"),
        }
    )


def threshold_metrics(
    df: DataFrame,
    cutoff: Column,
    truth: str = "y_true",
    pred: str = "y_pred",
    by: Sequence[str] = (),
    min_n: int = DEFAULTS.min_n,
) -> DataFrame:
    """One screening question; the cut-off is a number or a value per row."""
    counts = _counts(F.col(truth), F.col(pred), cutoff)
    rows = finite_rows(df, truth, pred)
    return with_rates(grouped(rows, by, False, *[c.alias(k) for k, c in counts.items()]), min_n)


def screening(
    df: DataFrame,
    truth: str = "y_true",
    pred: str = "y_pred",
    sex: str = "sex",
    by: Sequence[str] = (),
    pooled: bool = False,
    cfg: AuditConfig = DEFAULTS,
) -> DataFrame:
    """All bands, per group and optionally pooled, from one pass.

    The pass counts every cell of every band side by side, so rows are not
    multiplied by the bands. The pooled rows are grouping sets over the small
    table of counts, since counts add up.
    """
    questions = bands(sex, cfg)
    wide: list[Column] = []
    for name, cut, _ in questions:
        wide += [c.alias(f"{name}_{k}") for k, c in _counts(F.col(truth), F.col(pred), cut).items()]
    counts = grouped(finite_rows(df, truth, pred), by, False, *wide)
    if pooled:
        sums = [F.sum(c).alias(c) for c in counts.columns if c not in set(by)]
        counts = grouped(counts, by, True, *sums)
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("band"),
                F.lit(fixed).cast("double").alias("threshold"),
                *[F.col(f"{name}_{k}").alias(k) for k in CELLS],
            )
            for name, _, fixed in questions
        ]
    )
    long = counts.select(*by, F.inline(cells))
    return with_rates(long, cfg.min_n)
