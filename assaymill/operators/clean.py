"""Row filters and missing-value rules shared by every audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.DoubleType, T.FloatType)


def _bounded(column: Column) -> Column:
    """TRUE for a real number, FALSE for NaN and the infinities, NULL for NULL.

    Spark orders NaN above infinity, so one comparison settles all of them and
    names the value only once.
    """
    return F.abs(column.cast("double")) < F.lit(float("inf"))


def finite(column: Column) -> Column:
    """TRUE for a real number, else FALSE."""
    return F.coalesce(_bounded(column), F.lit(False))


def all_finite(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Undefined and unmeasured are both NULL from here on."""
    return df.select(
        *[
            F.nanvl(F.col(f.name), F.lit(None)).alias(f.name)
            if isinstance(f.dataType, FLOATING)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the rows where every named column is finite.

    The bare comparison lets Spark push IS NOT NULL down to the scan.
    """
    return df.where(reduce(lambda a, b: a & b, [_bounded(F.col(c)) for c in columns]))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys appear once."""
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def finite_summary(df: DataFrame, *columns: str, by: Sequence[str] = (), min_n: int = 2) -> DataFrame:
    """How many rows the filter keeps and drops, and whether enough remain."""
    kept = all_finite(columns)
    return df.groupBy(*by).agg(
        F.count_if(kept).alias("n_kept"),
        F.count_if(~kept).alias("n_dropped"),
        (F.count_if(kept) >= F.lit(min_n)).alias("enough"),
    )


def non_finite_gate(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Long table of non-finite counts per group and column."""
    counts = df.groupBy(*by).agg(*[F.count_if(~finite(F.col(c))).alias(c) for c in columns])
    return counts.unpivot(list(by), list(columns), "column", "n_bad").where(F.col("n_bad") > 0)


def non_finite_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str], row_id: str) -> DataFrame:
    """One row per bad cell: the group, the ``column`` and the id of the row it stands in."""
    bad = F.array_compact(F.array(*[F.when(~finite(F.col(c)), F.lit(c)) for c in columns]))
    return df.select(*by, row_id, F.explode(bad).alias("column"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round numbers for publication; text and booleans are left alone."""
    numeric = (T.NumericType,)
    return df.select(
        *[
            F.round(F.col(f.name).cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, numeric)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_undefined(df: DataFrame, undefined: Sequence[str]) -> DataFrame:
    """Remove columns that may not be model inputs."""
    return df.drop(*undefined)


def drop_positions(vector: Column, names: Sequence[str], undefined: Sequence[str]) -> Column:
    """Array form of :func:`drop_undefined`: drop by the position of the name."""
    keep = [i for i, n in enumerate(names) if n not in set(undefined)]
    return F.array(*[vector[i] for i in keep])


def rename_by_alias(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """Rename columns to their logical names.

    Both sides are compared lower-cased and without punctuation; for each logical
    field the first alias that is present wins.
    """
    simple: dict[str, str] = {}
    for name in df.columns:
        simple.setdefault("".join(ch for ch in name.lower() if ch.isalnum() and ch.isascii()), name)
    mapping: dict[str, str] = {}
    for logical, spellings in aliases.items():
        hit = next((simple[s] for s in spellings if s in simple), None)
        if hit is not None and hit not in mapping:
            mapping[hit] = logical
    absent = [r for r in required if r not in mapping.values()]
    if absent:
        raise ValueError(f"no column for {absent}; the table has {df.columns}")
    return df.withColumnsRenamed(mapping)
