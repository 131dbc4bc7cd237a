"""Prediction tables: read, name, enrich and store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.functions.names import PREDICTION_ALIASES
from assaymill.functions.who import severity_band
from assaymill.operators.clean import nan_to_null, rename_by_alias
from assaymill.sources.sinks import Stored, store

NUMERIC = ("y_true", "y_pred", "ita", "confidence", "sigma", "age")


def read_predictions(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV, JSON or Parquet by suffix, with logical column names and NULL for NaN.

    Text formats are read as text and cast, so no pass is spent on guessing types.
    JSON has one record per line, whatever its suffix; a file that is one array
    needs ``multi_line`` (and is read by one task), and is refused without it.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        df = reader.option("header", True).csv(path)
    elif kind in ("json", "jsonl", "ndjson"):
        df = reader.option("multiLine", multi_line).option("primitivesAsString", True).json(path)
        if "_corrupt_record" in df.columns:
            raise ValueError(f"{path!r} has records that are no JSON line; an array needs multi_line=True")
    elif kind == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"cannot tell the format of {path!r}")
    return named_predictions(df)


def named_predictions(df: DataFrame) -> DataFrame:
    """Canonical columns; a missing sex counts as F and a missing site as Unknown."""
    df = rename_by_alias(df, PREDICTION_ALIASES, ["y_true", "y_pred"])
    casts = {c: F.col(c).try_cast("double") for c in NUMERIC if c in df.columns}
    fills = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in (("sex", "F"), ("site", "Unknown"))}
    return nan_to_null(df.withColumns({**casts, **fills}))


def with_attributes(predictions: DataFrame, people: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """One row per patient: attributes, truth, prediction, error, severity."""
    rows = people.select("patient_id", "site", "sex", "age", "y_true").join(predictions, "patient_id")
    return rows.select(
        "patient_id",
        "site",
        "sex",
        "age",
        F.col("y_true").alias("hb_true"),
        F.round("y_pred", 4).alias("hb_pred"),
        (F.round(F.col("y_pred") - F.col("y_true"), 4) + F.lit(0.0)).alias("error"),
        severity_band(F.col("y_true"), F.col("sex"), cfg).alias("severity"),
    )


def write_predictions(df: DataFrame, path: str, partitions: Sequence[str] = ("head", "fold"), settings: dict[str, object] | None = None, corpus: str = "unknown") -> Stored:
    """Store per-patient predictions; rows without truth or prediction are left out, and counted."""
    return store(df, path, F.col("hb_true").isNotNull() & F.col("hb_pred").isNotNull(), partitions, settings, corpus)


def stored_by_head(df: DataFrame) -> DataFrame:
    """What a stored prediction table holds, per head."""
    return df.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs("error")), 4).alias("mae"),
        F.min("hb_pred").alias("lowest"),
        F.max("hb_pred").alias("highest"),
    )
