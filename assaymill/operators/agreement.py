"""Agreement between a truth and a prediction column.

Everything here is one partial aggregation: the shuffle carries one small buffer
per group and map task, whatever the number of rows, so a group that holds a
third of the table costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import DEFAULTS, Z_LIMITS
from assaymill.operators.clean import finite_rows

# Below this a spread counts as zero and the ratio over it as undefined.
FLAT = 1e-12
FLAT_MEAN = 1e-9
POOLED = "pooled"


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(p - t))


def rmse(t: Column, p: Column) -> Column:
    d = p - t
    return F.sqrt(F.avg(d * d))


def r2(t: Column, p: Column) -> Column:
    d = p - t
    sst = F.regr_sxx(t, t)
    return F.when(sst >= FLAT, 1.0 - F.sum(d * d) / sst)


def explained_variance(t: Column, p: Column) -> Column:
    spread = F.var_pop(t)
    return F.when(spread >= FLAT, 1.0 - F.var_pop(p - t) / spread)


def pearson(t: Column, p: Column) -> Column:
    st, sp = F.stddev_pop(t), F.stddev_pop(p)
    return F.when((st >= FLAT) & (sp >= FLAT), F.covar_pop(t, p) / (st * sp))


def sd_difference(t: Column, p: Column) -> Column:
    return F.when(F.count(t) > 1, F.stddev_samp(p - t)).otherwise(F.lit(0.0))


def proportional_slope(t: Column, p: Column) -> Column:
    mid = (t + p) / 2.0
    wide = (F.count(t) > 2) & ((F.max(mid) - F.min(mid)) > FLAT_MEAN)
    return F.when(wide, F.regr_slope(p - t, mid))


def within(t: Column, p: Column, margin: float) -> Column:
    return F.avg((F.abs(p - t) <= margin).cast("double"))


def agreement_columns(t: Column, p: Column) -> list[Column]:
    bias, sd = F.avg(p - t), sd_difference(t, p)
    return [
        F.count(t).alias("n"),
        mae(t, p).alias("mae"),
        rmse(t, p).alias("rmse"),
        r2(t, p).alias("r2"),
        explained_variance(t, p).alias("explained_variance"),
        pearson(t, p).alias("pearson_r"),
        bias.alias("bias"),
        sd.alias("sd_diff"),
        (bias - Z_LIMITS * sd).alias("loa_lower"),
        (bias + Z_LIMITS * sd).alias("loa_upper"),
        proportional_slope(t, p).alias("proportional_slope"),
        within(t, p, 1.0).alias("within_1"),
        within(t, p, 2.0).alias("within_2"),
    ]


def grouped(df: DataFrame, by: Sequence[str], pooled: bool, *columns: Column) -> DataFrame:
    """Group by ``by``; with ``pooled`` also the grand total, labelled so.

    The grand total is a second grouping set of the same pass. Group columns
    come back as text because a total has no group value.
    """
    if not by:
        return df.agg(*columns)
    if not pooled:
        return df.groupBy(*by).agg(*columns)
    level = F.grouping_id()
    keys = [F.col(b) for b in by]
    out = df.groupingSets([keys, []], *keys).agg(level.alias("_level"), *columns)
    named = [F.when(F.col("_level") == 0, F.col(b).cast("string")).otherwise(POOLED).alias(b) for b in by]
    rest = [c for c in out.columns if c not in set(by) and c != "_level"]
    return out.select(*named, *rest)


def agreement(
    df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = (), pooled: bool = False
) -> DataFrame:
    """The full report per group: error, correlation, limits, slope, coverage."""
    rows = finite_rows(df, truth, pred)
    return grouped(rows, by, pooled, *agreement_columns(F.col(truth), F.col(pred)))


def headline(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    return grouped(
        finite_rows(df, truth, pred),
        by,
        False,
        F.count(t).alias("n"),
        mae(t, p).alias("mae"),
        rmse(t, p).alias("rmse"),
        F.avg(p - t).alias("bias"),
    )


def bland_altman(
    df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = (), margin: float = 1.0
) -> DataFrame:
    """Bias, its spread, limits of agreement, slope and share within a margin."""
    t, p = F.col(truth), F.col(pred)
    bias, sd = F.avg(p - t), sd_difference(t, p)
    return grouped(
        finite_rows(df, truth, pred),
        by,
        False,
        F.count(t).alias("n"),
        bias.alias("bias"),
        sd.alias("sd_diff"),
        (bias - Z_LIMITS * sd).alias("loa_lower"),
        (bias + Z_LIMITS * sd).alias("loa_upper"),
        proportional_slope(t, p).alias("proportional_slope"),
        within(t, p, margin).alias("coverage"),
    )


def mean_sd(df: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and spread of a metric over folds or seeds.

    ``n_runs`` of one is a single run with no spread; of zero there is nothing.
    """
    v = F.when(~F.isnan(metric), F.col(metric))
    out = grouped(
        df,
        by,
        False,
        F.count(v).alias("n_runs"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
    )
    n = F.col("n_runs")
    return out.withColumns(
        {
            "half_width": F.when(n > 1, Z_LIMITS * F.col("sd") / F.sqrt(n)),
            "text": F.when(n == 0, "n/a")
            .when(n == 1, F.format_string("%.3f (single run)", "mean"))
            .otherwise(F.format_string("%.3f ± %.3f", "mean", "sd")),
        }
    )


def residual_sigma(df: DataFrame, z: float) -> DataFrame:
    """Spread of the residual read back from stored limits of agreement."""
    sigma = (F.col("loa_upper") - F.col("bias")) / z
    return df.withColumn("sigma", F.when(sigma > 0, sigma))


def subgroup_table(
    df: DataFrame,
    by: Sequence[str],
    truth: str = "y_true",
    pred: str = "y_pred",
    positive: Column | None = None,
    min_n: int = DEFAULTS.subgroup_min_n,
) -> DataFrame:
    """One row per subgroup. A small group keeps its row, without metrics."""
    t, p = F.col(truth), F.col(pred)
    hit = (t < DEFAULTS.cut_other) if positive is None else positive
    enough = F.count(t) >= min_n
    out = finite_rows(df, truth, pred).groupBy(*by).agg(
        F.count(t).alias("n"),
        F.when(enough, mae(t, p)).alias("mae"),
        F.when(enough, rmse(t, p)).alias("rmse"),
        F.when(enough, F.avg(p - t)).alias("bias"),
        F.when(enough, F.avg(t)).alias("mean_truth"),
        F.count_if(hit).alias("n_positive"),
    )
    return out.withColumn("verdict", F.when(F.col("n") < min_n, "underpowered").otherwise("ok"))


def subgroup_spread(table: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """How far the worst subgroup lies from the mean of the subgroups.

    Ties go to the group that sorts first.
    """
    scored = table.where(F.col("mae").isNotNull())
    worst_first = F.struct(-F.col("mae"), F.col(group))
    out = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.avg("mae").alias("mean_of_groups_mae"),
        F.avg("bias").alias("mean_of_groups_bias"),
        F.max("mae").alias("worst_mae"),
        F.min_by(group, worst_first).alias("worst_group"),
        F.min_by("n", worst_first).alias("worst_n"),
        F.min_by("bias", F.struct(-F.abs("bias"), F.col(group))).alias("_worst_bias"),
    )
    return out.select(
        *by,
        "n_groups",
        "mean_of_groups_mae",
        "mean_of_groups_bias",
        "worst_group",
        "worst_mae",
        "worst_n",
        (F.col("worst_mae") - F.col("mean_of_groups_mae")).alias("mae_gap"),
        F.abs(F.col("_worst_bias") - F.col("mean_of_groups_bias")).alias("bias_gap"),
    )


def fusion_comparison(single: DataFrame, fused: DataFrame, group: str) -> DataFrame:
    """Does a fused model close the gap of the worst group?

    Both inputs hold one ``mae`` per group; a group missing on one side counts
    on the other only.
    """
    both = single.select(group, F.col("mae").alias("s")).join(
        fused.select(group, F.col("mae").alias("f")), group, "full"
    )
    out = both.agg(
        F.avg("s").alias("pooled_single"),
        F.avg("f").alias("pooled_fused"),
        F.max("s").alias("worst_single"),
        F.max("f").alias("worst_fused"),
    )
    return out.withColumn(
        "spread_reduction",
        (F.col("worst_single") - F.col("pooled_single")) - (F.col("worst_fused") - F.col("pooled_fused")),
    )

