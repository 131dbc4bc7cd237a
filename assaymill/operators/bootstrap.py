"""Block bootstrap interval of the mean difference.

Rows are assigned to random blocks by a hash of their id and reduced to one sum
per block, so one pass over the table is followed by work that depends only on
blocks and replicates. With as many blocks as rows this is the ordinary
bootstrap; with fewer it resamples random blocks, which has the same expectation
of variance because membership is random.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import DEFAULTS
from assaymill.operators.agreement import grouped
from assaymill.operators.clean import finite_rows
from assaymill.session import written


def poisson_steps(rate: float = 1.0, levels: int = 10) -> list[float]:
    """Cumulative Poisson probabilities: P(X <= 0), P(X <= 1), ..."""
    terms = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(levels)]
    return [sum(terms[: k + 1]) for k in range(levels)]


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from an md5, the same in every engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def blocks_of(df: DataFrame, row_id: str, truth: str, pred: str, by: Sequence[str], n_blocks: int) -> DataFrame:
    block = F.pmod(F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n_blocks))
    return (
        finite_rows(df, truth, pred)
        .groupBy(*by, block.alias("block"))
        .agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(pred) - F.col(truth)).alias("s"))
    )


def bias_interval(
    df: DataFrame,
    row_id: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    by: Sequence[str] = (),
    seed: int = DEFAULTS.seed,
    replicates: int = 2000,
    n_blocks: int = 1024,
) -> DataFrame:
    """Percentile interval with Poisson(1) weights per block and replicate."""
    blocks = blocks_of(df, row_id, truth, pred, by, n_blocks)
    cells = df.sparkSession.range(replicates * n_blocks).select(
        F.floor(F.col("id") / n_blocks).alias("rep"), (F.col("id") % n_blocks).alias("block")
    )
    # One draw per replicate and block, shared by all groups.
    drawn = cells.withColumn("u", hash_unit(F.lit(seed), F.col("rep"), F.col("block")))
    weight = sum(((F.col("u") >= F.lit(c)).cast("int") for c in poisson_steps()), F.lit(0))
    # No filter on the weight: pushed below, it would hash again for every step.
    drawn = drawn.select("rep", "block", weight.alias("w"))
    stats = drawn.join(written(blocks), "block").groupBy(*by, "rep").agg(
        (F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("m"))).alias("stat")
    )
    return _percentiles(stats, by, "poisson block", n_blocks)


def bias_interval_multinomial(
    df: DataFrame,
    row_id: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    by: Sequence[str] = (),
    seed: int = DEFAULTS.seed,
    replicates: int = 2000,
    n_blocks: int = 256,
) -> DataFrame:
    """Multinomial form: every replicate draws as many blocks as there are."""
    blocks = blocks_of(df, row_id, truth, pred, by, n_blocks)
    spark = df.sparkSession
    draws = spark.range(replicates * n_blocks).select(
        F.floor(F.col("id") / n_blocks).alias("rep"), (F.col("id") % n_blocks).alias("draw")
    )
    pick = F.floor(hash_unit(F.lit(seed), F.col("rep"), F.col("draw")) * n_blocks)
    counts = draws.groupBy("rep", pick.alias("block")).agg(F.count(F.lit(1)).alias("w"))
    stats = counts.join(written(blocks), "block").groupBy(*by, "rep").agg(
        (F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("m"))).alias("stat")
    )
    return _percentiles(stats, by, "multinomial block", n_blocks)


def _percentiles(stats: DataFrame, by: Sequence[str], method: str, n_blocks: int) -> DataFrame:
    # One value per replicate: the group size is the replicate count.
    return grouped(
        stats,
        by,
        False,
        F.count("stat").alias("replicates"),
        F.avg("stat").alias("boot_mean"),
        F.percentile("stat", F.lit(0.025)).alias("ci_low"),
        F.percentile("stat", F.lit(0.975)).alias("ci_high"),
        F.lit(method).alias("method"),
        F.lit(n_blocks).alias("n_blocks"),
    )
