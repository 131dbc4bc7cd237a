"""One way to store a table: counted in the pass that writes it, described, and whole or not there.

Rows are counted by metrics that Spark observes while the write job runs, so no second
pass reads what was stored. Data and manifest go to a staging folder beside the target,
which takes its name only when both are complete; a job that dies leaves nothing a
reader could take for a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assaymill.sources.feature_store import config_fingerprint

MANIFEST = "_manifest"  # readers pass over names with an underscore


@dataclass(frozen=True)
class Stored:
    """What a sink did: rows it was given, stored and left out, and the run's settings."""

    rows_in: int
    rows_written: int
    rows_dropped: int
    columns: int
    fingerprint: str
    corpus: str


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def store(
    df: DataFrame,
    path: str,
    keep: Column | None = None,
    partitions: Sequence[str] = (),
    settings: dict[str, object] | None = None,
    corpus: str = "unknown",
) -> Stored:
    """Write the rows where ``keep`` is true (all by default) to ``path`` as Parquet.

    A path that exists is refused. Returns the counts, which the manifest holds as well.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    files, target = _file_system(spark, path)
    if files.exists(target):
        raise FileExistsError(f"{path!r} exists")
    staging = f"{path}-staging-{uuid.uuid4().hex}"
    wanted = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    seen = Observation()
    counted = df.withColumn("_wanted", wanted).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_wanted").alias("kept"))
    rows = counted.where("_wanted").drop("_wanted")
    writer = rows.write.partitionBy(*partitions) if partitions else rows.write
    try:
        writer.parquet(staging)
        n, kept = seen.get["rows"], seen.get["kept"]
        done = Stored(n, kept, n - kept, len(rows.columns), config_fingerprint(settings or {}), corpus)
        spark.createDataFrame([(json.dumps(asdict(done)),)], "value string").coalesce(1).write.text(f"{staging}/{MANIFEST}")
        if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(staging), target):
            raise FileExistsError(f"{path!r} came to exist meanwhile")
    except BaseException:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)
        raise
    return done


def manifest_of(spark: SparkSession, path: str) -> Stored:
    """What ``store`` noted about the table at ``path``."""
    return Stored(**json.loads(spark.read.text(f"{path.rstrip('/')}/{MANIFEST}").first()[0]))
