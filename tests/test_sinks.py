"""Sinks count in the pass that writes, and leave a whole table or none."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaymill.operators import clean
from assaymill.operators import integrity as I
from assaymill.sources import predictions, sinks


def test_store_counts_and_describes(spark, tmp_path):
    df = spark.range(100).select(F.when(F.col("id") % 4 != 0, F.col("id")).alias("v"), (F.col("id") % 3).alias("p"))
    path = str(tmp_path / "out")
    done = sinks.store(df.repartition(6), path, F.col("v") > 10, ["p"], {"seed": 1}, "real")
    assert (done.rows_in, done.rows_written, done.rows_dropped) == (100, 67, 33)
    assert spark.read.parquet(path).count() == 67
    assert sinks.manifest_of(spark, path) == done and done.corpus == "real"
    with pytest.raises(FileExistsError):
        sinks.store(df, path)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = spark.range(10).select(F.expr("raise_error('stop')").cast("string").alias("v"))
    with pytest.raises(PySparkException):
        sinks.store(broken, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_empty_table(spark, tmp_path):
    done = sinks.store(spark.range(0), str(tmp_path / "out"))
    assert (done.rows_in, done.rows_written) == (0, 0)


def test_predictions_without_a_value_are_counted(spark, tmp_path):
    rows = [("a", "h", "f", 10.0, 11.0), ("b", "h", "f", 10.0, None), ("c", "h", "g", None, 9.0)]
    df = spark.createDataFrame(rows, "patient_id string, head string, fold string, hb_true double, hb_pred double")
    done = predictions.write_predictions(df, str(tmp_path / "out"))
    assert (done.rows_written, done.rows_dropped) == (1, 2)


def test_offenders_are_named(spark):
    rows = [(k, "a" if k % 2 else None, float("nan") if k % 3 == 0 else 1.0, None if k == 7 else 2.0) for k in range(60)]
    bad = clean.non_finite_rows(spark.createDataFrame(rows, "id long, g string, u double, v double"), ["u", "v"], ["g"], "id")
    got = {(r.g, r.column): (r.n, r.first) for r in I.first_offenders(bad, ["g", "column"], "id", 8).collect()}
    assert got == {("a", "u"): (10, "3,9,15,21,27,33,39,45"), ("a", "v"): (1, "7"), (None, "u"): (10, "0,6,12,18,24,30,36,42")}
