"""Event sources: the same reader for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def stream_events(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = EVENT_SCHEMA,
    kind: str = "parquet",
    name: str = "*",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Files arriving in a folder. Arrival time is the ``ts`` they carry."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", name)
        .format(kind)
        .load(folder)
    )
