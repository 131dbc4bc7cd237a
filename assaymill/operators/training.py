"""Class centres, weights, standardisation and loss tables for heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT_EPS = 1e-6


def class_centres(train: DataFrame, klass: Column, value: str, k: int) -> DataFrame:
    """Mean label per class; a class without members takes the overall mean."""
    v = F.col(value)
    wide = train.agg(*[F.coalesce(F.avg(F.when(klass == i, v)), F.avg(v)).alias(f"c{i}") for i in range(k)])
    rows = [F.struct(F.lit(i).alias("klass"), F.col(f"c{i}").alias("centre")) for i in range(k)]
    return wide.select(F.inline(F.array(*rows)))


def class_weights(train: DataFrame, klass: Column, k: int) -> DataFrame:
    """Inverse-frequency weights whose mean over the rows is one.

    A class without members has weight one before normalising.
    """
    wide = train.agg(F.count(klass).alias("n"), *[F.count_if(klass == i).alias(f"n{i}") for i in range(k)])
    freq = [F.col(f"n{i}") / F.greatest(F.col("n"), F.lit(1)) for i in range(k)]
    raw = [F.when(F.col(f"n{i}") > 0, 1.0 / (freq[i] + WEIGHT_EPS)).otherwise(1.0) for i in range(k)]
    mean = sum((f * w for f, w in zip(freq, raw)), F.lit(0.0))
    rows = [
        F.struct(F.lit(i).alias("klass"), F.col(f"n{i}").alias("n"), (raw[i] / F.col("mean")).alias("weight"))
        for i in range(k)
    ]
    return wide.withColumn("mean", F.greatest(mean, F.lit(WEIGHT_EPS))).select(F.inline(F.array(*rows)))


def weight_lookup(weights: DataFrame, klass: Column) -> Column:
    """Weight of a row's class: the k values come in as one scalar subquery."""
    table = weights.agg(F.array_sort(F.collect_list(F.struct("klass", "weight")))).scalar()
    return F.element_at(table, klass.cast("int") + 1)["weight"]


def standardise(
    df: DataFrame, columns: Sequence[str], split: str = "split", fit_on: str | None = "train"
) -> DataFrame:
    """Zero mean, unit population spread; a dead column becomes zero.

    Statistics come from the training split only; ``fit_on=None`` uses all rows.
    """
    base = df if fit_on is None else df.where(F.col(split) == fit_on)
    stats = base.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).alias("v")
    ).scalar()
    out = df.withColumn("_stats", stats)
    for_column = {
        c: F.when(F.col(f"_stats.s_{c}") > 1e-12, (F.col(c) - F.col(f"_stats.m_{c}")) / F.col(f"_stats.s_{c}"))
        .when(F.col(c).isNotNull(), 0.0)
        for c in columns
    }
    return out.withColumns(for_column).drop("_stats")


def hybrid(df: DataFrame, blocks: dict[str, Sequence[str]], out: str = "features", **fit: object) -> DataFrame:
    """Blocks of columns, each standardised on its own, joined into one vector."""
    for columns in blocks.values():
        df = standardise(df, columns, **fit)  # type: ignore[arg-type]
    parts = [F.array(*[F.col(c) for c in columns]) for columns in blocks.values()]
    return df.withColumn(out, F.concat(*parts))


def fingerprint(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a feature table: two equal tables share it."""
    h = F.xxhash64(F.col(row_id).cast("string"), *[F.col(c) for c in columns])
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum")
    )
