"""Leakage, subset and set-equality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaymill.operators.clean import join_null_safe


def split_leakage(assigned: DataFrame, row_id: str, fold: str = "fold", split: str = "split") -> DataFrame:
    """Ids in two splits of a fold, or twice in one split."""
    cells = assigned.groupBy(fold, row_id).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_set(split)).alias("splits")
    )
    return cells.where(F.col("n_rows") > 1).select(
        fold,
        row_id,
        "n_rows",
        F.concat_ws(",", "splits").alias("splits"),
        F.when(F.size("splits") > 1, "overlap").otherwise("repeat").alias("kind"),
    )


def split_overlap(assigned: DataFrame, row_id: str, a: str, b: str, split: str = "split") -> DataFrame:
    """Ids present in both of two splits."""
    return (
        assigned.where(F.col(split) == a).select(row_id).intersect(assigned.where(F.col(split) == b).select(row_id))
    )


def file_leakage(assigned: DataFrame, files: DataFrame, row_id: str, path: str, split: str = "split") -> DataFrame:
    """Paths that two splits can reach."""
    reach = assigned.select(row_id, split).join(files.select(row_id, path), row_id)
    ends = reach.groupBy(path).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
    return ends.where(F.col("first_split") != F.col("last_split"))


def first_offenders(df: DataFrame, by: Sequence[str], item: str, k: int = 5) -> DataFrame:
    """The first k offenders of each group and how many there are.

    Spark prunes each map task to k rows per group before the shuffle.
    """
    top = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(item))).where(F.col("_rn") <= k)
    listed = top.groupBy(*by).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_rn", item))), lambda x: x[item].cast("string"))).alias("first")
    )
    return join_null_safe(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), listed, list(by))


def id_sets(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """How two id sets differ, in one aggregation over their union."""
    marked = a.select(row_id, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(row_id, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per_id = marked.groupBy(row_id).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = per_id.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("in_both"),
        F.count_if(F.col("b") == 0).alias("only_left"),
        F.count_if(F.col("a") == 0).alias("only_right"),
    )
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def subset(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Rows of the given ids."""
    return df.join(ids.select(row_id).distinct(), row_id, "left_semi")


def missing(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Requested ids without a row; a subset is valid when there are none."""
    return ids.select(row_id).distinct().join(df.select(row_id), row_id, "left_anti")


def union_of_keys(*tables: DataFrame) -> DataFrame:
    """Rows of different shapes under the union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def unexpected_values(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Values outside the known ones, with their counts."""
    return (
        df.where(F.col(column).isNull() | ~F.col(column).isin(*known))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
