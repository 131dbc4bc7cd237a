"""Result tables assembled from agreement and subgroup operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.operators import agreement as A

METRICS = ("n", "mae", "rmse", "r2", "pearson_r", "bias", "loa_lower", "loa_upper", "within_1", "within_2")


def head_table(df: DataFrame, site: str = "site", by: Sequence[str] = ("head",)) -> DataFrame:
    """One row per head: the report plus the spread over the sites."""
    keys = list(by)
    report = A.agreement(df, by=keys).select(*keys, *METRICS)
    spread = A.subgroup_spread(A.subgroup_table(df, [*keys, site]), site, by=keys)
    spread = spread.select(
        *keys,
        F.col("mae_gap").alias("site_mae_gap"),
        F.col("bias_gap").alias("site_bias_gap"),
        F.col("worst_group").alias("worst_site"),
        F.col("worst_n").alias("worst_site_n"),
    )
    return report.join(spread, keys, "left")


def best_head(table: DataFrame) -> DataFrame:
    best = F.struct("r2", F.col("mae") * -1)
    return table.agg(F.max_by("head", best).alias("head"), F.max("r2").alias("r2"))


def holdout_table(scored: DataFrame, site_means: DataFrame, sex: str = "sex") -> DataFrame:
    """Cross-site result per head and direction, with both sites' mean truth."""
    keys = ["head", "fold", "train_site", "test_site"]
    report = A.agreement(scored, by=keys).select(*keys, *METRICS)
    gap = A.subgroup_spread(A.subgroup_table(scored, [*keys, sex]), sex, by=keys)
    out = report.join(gap.select(*keys, F.col("mae_gap").alias("sex_mae_gap")), keys, "left")
    for side in ("test", "train"):
        means = site_means.select(F.col("site").alias(f"{side}_site"), F.col("mean").alias(f"mean_truth_{side}_site"))
        out = out.join(means, f"{side}_site", "left")
    return out.withColumn("selection", F.lit("no validation rows, nothing selected"))
