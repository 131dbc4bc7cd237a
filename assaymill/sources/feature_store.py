"""Stored feature tables, keyed by what changes their numbers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.operators.integrity import id_sets

KEYS = ("kind", "roi", "balance")


def config_fingerprint(settings: dict[str, object]) -> str:
    """Digest of the settings a table was computed with."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def save(df: DataFrame, path: str, kind: str, roi: str, balance: str, fingerprint: str) -> None:
    """Replace one partition; ``df`` has ``patient_id`` and the feature columns."""
    keyed = df.withColumns({"kind": F.lit(kind), "roi": F.lit(roi), "balance": F.lit(balance), "fingerprint": F.lit(fingerprint)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def load(
    spark: SparkSession, path: str, kind: str, roi: str, balance: str, fingerprint: str, ids: DataFrame | None = None,
    row_id: str = "patient_id",
) -> DataFrame:
    """Read one partition.

    A table from other settings is refused, and so is one whose ids are not
    exactly the requested ones.
    """
    stored = spark.read.parquet(path).where((F.col("kind") == kind) & (F.col("roi") == roi) & (F.col("balance") == balance))
    fresh = stored.where(F.col("fingerprint") == fingerprint)
    if fresh.isEmpty():
        raise LookupError(f"no stored features for {kind}/{roi}/{balance} with these settings")
    if ids is not None:
        found = id_sets(fresh, ids, row_id).first()
        if not found["equal"]:
            raise LookupError(
                f"stored ids differ: {found['only_left']} not wanted, {found['only_right']} missing"
            )
    return fresh.drop("fingerprint", *KEYS)
