"""Agreement, subgroup and summary queries over the prediction view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.functions.who import sex_cutoff
from assaymill.operators import agreement as A
from assaymill.operators import clean
from assaymill.plans.registry import published, query, r
from assaymill.plans.views import PRED

P = f"({PRED.sql()})"
OK = f"(SELECT *, y_pred - y_true AS d FROM {P} WHERE y_pred IS NOT NULL)"

REPORT_SQL = ", ".join(
    [
        "count(*) AS n",
        r("avg(abs(d))", "mae"),
        r("sqrt(avg(d*d))", "rmse"),
        r("CASE WHEN regr_sxx(y_true,y_true) >= 1e-12 THEN 1 - sum(d*d)/regr_sxx(y_true,y_true) END", "r2"),
        r("CASE WHEN var_pop(y_true) >= 1e-12 THEN 1 - var_pop(d)/var_pop(y_true) END", "explained_variance"),
        r(
            "CASE WHEN stddev_pop(y_true) >= 1e-12 AND stddev_pop(y_pred) >= 1e-12 THEN"
            " covar_pop(y_true,y_pred)/(stddev_pop(y_true)*stddev_pop(y_pred)) END",
            "pearson_r",
        ),
        r("avg(d)", "bias"),
        r("coalesce(stddev_samp(d), 0)", "sd_diff"),
        r("avg(d) - 1.96e0*coalesce(stddev_samp(d), 0)", "loa_lower"),
        r("avg(d) + 1.96e0*coalesce(stddev_samp(d), 0)", "loa_upper"),
        r(
            "CASE WHEN count(*) > 2 AND max((y_true+y_pred)/2) - min((y_true+y_pred)/2) > 1e-9"
            " THEN regr_slope(d, (y_true+y_pred)/2) END",
            "proportional_slope",
        ),
        r("avg(CASE WHEN abs(d) <= 1 THEN 1.0e0 ELSE 0.0e0 END)", "within_1"),
        r("avg(CASE WHEN abs(d) <= 2 THEN 1.0e0 ELSE 0.0e0 END)", "within_2"),
    ]
)


@query(
    "agreement_report",
    "A1 A2 A3 A4 A5 A7 A8 A9 A10 F11 L9",
    f"SELECT CASE WHEN grouping(site) = 1 THEN 'pooled' ELSE site END AS site, {REPORT_SQL}"
    f" FROM {OK} GROUP BY GROUPING SETS ((site), ())",
)
def agreement_report(spark: SparkSession, sf: str) -> DataFrame:
    return published(A.agreement(PRED.frame(spark, sf), by=["site"], pooled=True))


@query(
    "agreement_by_supplier",
    "A10 at a high number of groups",
    f"SELECT l_suppkey, sex, {REPORT_SQL} FROM {OK} GROUP BY l_suppkey, sex",
)
def agreement_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return published(A.agreement(PRED.frame(spark, sf), by=["l_suppkey", "sex"]))


@query(
    "headline_summary",
    "A11",
    f"SELECT head, count(*) AS n, {r('avg(abs(d))', 'mae')}, {r('sqrt(avg(d*d))', 'rmse')},"
    f" {r('avg(d)', 'bias')} FROM {OK} GROUP BY head",
)
def headline_summary(spark: SparkSession, sf: str) -> DataFrame:
    return published(A.headline(PRED.frame(spark, sf), by=["head"]))


@query(
    "bland_altman_margin",
    "A7 A8 A9",
    f"""SELECT sex, count(*) AS n, {r('avg(d)', 'bias')}, {r('stddev_samp(d)', 'sd_diff')},
    {r('avg(d) - 1.96e0*stddev_samp(d)', 'loa_lower')}, {r('avg(d) + 1.96e0*stddev_samp(d)', 'loa_upper')},
    {r('regr_slope(d, (y_true+y_pred)/2)', 'proportional_slope')},
    {r('avg(CASE WHEN abs(d) <= 0.8e0 THEN 1.0e0 ELSE 0.0e0 END)', 'coverage')} FROM {OK} GROUP BY sex""",
)
def bland_altman_margin(spark: SparkSession, sf: str) -> DataFrame:
    return published(A.bland_altman(PRED.frame(spark, sf), by=["sex"], margin=0.8))


@query(
    "finite_pair_filter",
    "F11",
    f"""SELECT site, cast(sum(CASE WHEN y_pred IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
    cast(sum(CASE WHEN y_pred IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
    sum(CASE WHEN y_pred IS NOT NULL THEN 1 ELSE 0 END) >= 2 AS enough FROM {P} GROUP BY site""",
)
def finite_pair_filter(spark: SparkSession, sf: str) -> DataFrame:
    return clean.finite_summary(PRED.frame(spark, sf), "y_true", "y_pred", by=["site"])


@query(
    "finite_joint_filter",
    "F12",
    f"""SELECT head, cast(count_if(ok) AS BIGINT) AS n_kept, cast(count_if(NOT ok) AS BIGINT) AS n_dropped,
    count_if(ok) >= 3 AS enough FROM (SELECT head, y_pred IS NOT NULL AND x IS NOT NULL AS ok FROM
    (SELECT head, y_pred, CASE WHEN ita > 60 THEN NULL ELSE ita END AS x FROM {P})) GROUP BY head""",
)
def finite_joint_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf).withColumn("ita", F.when(F.col("ita") > 60, F.lit(float("nan"))).otherwise(F.col("ita")))
    return clean.finite_summary(df, "y_true", "y_pred", "ita", by=["head"], min_n=3)


FOLDS = f"""SELECT head, l_suppkey % 5 AS fold, avg(abs(d)) AS mae FROM {OK}
 GROUP BY head, l_suppkey % 5"""


@query(
    "mean_sd_over_folds",
    "A13",
    f"""SELECT head, count(*) AS n_runs, {r('avg(mae)', 'mean')}, {r('stddev_samp(mae)', 'sd')},
    {r('1.96e0*stddev_samp(mae)/sqrt(count(*))', 'half_width')},
    printf('%.3f ± %.3f', avg(mae), stddev_samp(mae)) AS text FROM ({FOLDS}) GROUP BY head""",
)
def mean_sd_over_folds(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf).withColumn("fold", F.col("l_suppkey") % 5)
    return published(A.mean_sd(A.headline(df, by=["head", "fold"]), "mae", by=["head"]))


SUBGROUP = f"""SELECT site, sex, count(*) AS n, avg(abs(d)) AS mae, sqrt(avg(d*d)) AS rmse, avg(d) AS bias,
 avg(y_true) AS mean_truth, cast(sum(CASE WHEN y_true < CASE WHEN sex = 'M' THEN 13 ELSE 12 END
 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM {OK} GROUP BY site, sex"""


@query(
    "subgroup_table",
    "A14",
    f"""SELECT site, sex, n, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('bias', 'bias')},
    {r('mean_truth', 'mean_truth')}, n_positive,
    CASE WHEN n < 5 THEN 'underpowered' ELSE 'ok' END AS verdict FROM ({SUBGROUP})""",
)
def subgroup_table(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("y_true") < sex_cutoff(F.col("sex"))
    return published(A.subgroup_table(PRED.frame(spark, sf), ["site", "sex"], positive=hit))


@query(
    "subgroup_spread",
    "A15",
    f"""SELECT sex, count(*) AS n_groups, {r('avg(mae)', 'mean_of_groups_mae')},
    {r('avg(bias)', 'mean_of_groups_bias')}, arg_max(site, mae) AS worst_group, {r('max(mae)', 'worst_mae')},
    arg_max(n, mae) AS worst_n, {r('max(mae) - avg(mae)', 'mae_gap')},
    {r('abs(arg_max(bias, abs(bias)) - avg(bias))', 'bias_gap')} FROM ({SUBGROUP}) GROUP BY sex""",
)
def subgroup_spread(spark: SparkSession, sf: str) -> DataFrame:
    table = A.subgroup_table(PRED.frame(spark, sf), ["site", "sex"])
    return published(A.subgroup_spread(table, "site", by=["sex"]))


@query(
    "fusion_comparison",
    "A20 J15",
    f"""WITH s AS (SELECT site, avg(abs(d)) AS mae FROM {OK} WHERE head = 'regression' GROUP BY site),
    f AS (SELECT site, avg(abs(d)) AS mae FROM {OK} GROUP BY site)
    SELECT {r('avg(s.mae)', 'pooled_single')}, {r('avg(f.mae)', 'pooled_fused')},
    {r('max(s.mae)', 'worst_single')}, {r('max(f.mae)', 'worst_fused')},
    {r('(max(s.mae) - avg(s.mae)) - (max(f.mae) - avg(f.mae))', 'spread_reduction')}
    FROM s FULL JOIN f ON s.site = f.site""",
)
def fusion_comparison(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf)
    single = A.headline(df.where("head = 'regression'"), by=["site"])
    return published(A.fusion_comparison(single, A.headline(df, by=["site"]), "site"))


@query(
    "residual_sigma",
    "A43",
    f"""SELECT head, {r('avg(d)', 'bias')}, {r('avg(d) + 1.96e0*stddev_samp(d)', 'loa_upper')},
    {r('1.96e0*stddev_samp(d)/1.959963984540054e0', 'sigma')} FROM {OK} GROUP BY head""",
)
def residual_sigma(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.config import Z_INTERVAL

    limits = A.bland_altman(PRED.frame(spark, sf), by=["head"]).select("head", "bias", "loa_upper")
    return published(A.residual_sigma(limits, Z_INTERVAL))
