"""Label sheets from files, whatever their headers are called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.functions.names import LABEL_ALIASES
from assaymill.operators.clean import rename_by_alias

FIELDS = ("patient_id", "hb", "sex", "age", "site", "note")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One sheet, CSV or Parquet, as text columns under their logical names.

    A sheet without a site column takes the site from its file name. ``row_pos``
    follows the order of the rows in the file. Other columns stay: a withdrawal
    may stand in any of them.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name.lower().endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    # Bytes before the block are at least the rows before it, so the sum rises through the file.
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns], place.alias("row_pos"))
    df = rename_by_alias(df, LABEL_ALIASES, ["patient_id", "hb"])
    absent = {c: F.lit(None).cast("string") for c in FIELDS if c not in df.columns}
    if "site" in absent:
        absent["site"] = F.lit(name)
    return df.withColumns(absent)


def read_sheets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All sheets under one header; a column that a sheet lacks is NULL there."""
    out = read_sheet(spark, paths[0])
    for path in paths[1:]:
        out = out.unionByName(read_sheet(spark, path), allowMissingColumns=True)
    return out
