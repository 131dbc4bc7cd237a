"""No row may vanish: NULL keys, times, strata, groups and values, and JSON lines."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from assaymill.operators import events as E
from assaymill.operators import ordered as O
from assaymill.operators import splits as S
from assaymill.sources.predictions import read_predictions


def test_json_lines_and_arrays(spark, tmp_path):
    rows = [{"y_true": k, "y_pred": k + 0.5} for k in range(3)]
    lines, array = tmp_path / "a.json", tmp_path / "b.json"
    lines.write_text("\n".join(map(json.dumps, rows)))
    array.write_text(json.dumps(rows, indent=1))
    assert read_predictions(spark, str(lines)).count() == 3
    assert read_predictions(spark, str(array), multi_line=True).count() == 3
    with pytest.raises(ValueError):
        read_predictions(spark, str(array))


@pytest.fixture(scope="module")
def events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, None if k % 4 == 0 else f"k{k % 3}", None if k % 7 == 0 else start + dt.timedelta(seconds=k)) for k in range(40)]
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp")


def test_rate_limit_keeps_rows_without_key_or_time(events):
    got = {r.event_id: r.allowed for r in E.rate_limit(events, limit=2, window_ms=3_600_000).collect()}
    assert len(got) == 40
    nobody = [k for k in range(40) if k % 4 == 0 and k % 7]
    assert [k for k in nobody if got[k]] == nobody[:2]
    assert all(got[k] for k in range(40) if k % 7 == 0)


def test_daily_cap_keeps_rows_without_time(events):
    got = {r.event_id: r.accepted for r in E.daily_cap(events, 5).collect()}
    assert len(got) == 40 and sum(got.values()) == 5
    assert not any(got[k] for k in range(40) if k % 7 == 0)


def test_intake_rejects_rows_without_time(events):
    body = F.lit('{"model_id": "m", "band": "mild"}')
    got = E.intake(events.withColumn("body", body)).collect()
    assert len(got) == 40
    assert {r.code for r in got if r.ts is None} == {E.INVALID}


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(k, None if k % 4 == 0 else "ab"[k % 2], [None, math.nan, float(k)][k % 3 if k % 3 < 2 and k % 2 else 2]) for k in range(60)]
    return spark.createDataFrame(rows, "id long, g string, v double")


def test_splits_keep_rows_without_stratum(grouped):
    folds = S.kfold(grouped, "id", 5, strata=["g"])
    assert folds.where("split = 'test'").count() == 60
    assert folds.groupBy("fold").count().where("count <> 60").isEmpty()
    once = S.stratified_split(grouped, "id", "g")
    assert once.count() == 60 and once.where("g IS NULL").count() == 15


def test_an_id_with_two_strata_takes_the_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "b")], "id long, g string")
    assert {(r.id, r.g) for r in S.stratified_split(df, "id", "g").collect()} == {(1, "a"), (2, "b")}


def test_holdout_rejects_name_every_lost_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None), (5, " ")], "id long, site string")
    kept = {r.id for r in S.site_holdout(df, "id", "site", ["a", "b"]).collect()}
    lost = {r.id: r.reason for r in S.without_site(df, "id", "site", ["a", "b"]).collect()}
    assert lost == {3: "unlisted", 4: "missing", 5: "blank"} and kept | set(lost) == {1, 2, 3, 4, 5}


def test_ranks_and_quantiles_without_value(spark, grouped):
    small = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, math.nan)], "id long, v double")
    assert {r.id: r.r for r in O.average_rank(small, "v", "id", "r").collect()} == {1: 1.0, 2: None, 3: 2.0, 4: None}
    row = O.exact_quantiles(small, "v", "id", {"median": 0.5}).first()
    assert (row.n, row.median) == (2, 1.5)
    ranked = O.average_rank(grouped, "v", "id", "r", ["g"], rows_per_bucket=5)
    assert ranked.count() == 60
    assert {r.g for r in O.exact_quantiles(grouped, "v", "id", {"m": 0.5}, ["g"]).collect()} == {None, "a", "b"}


def test_no_bucket_exceeds_its_rows(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    cuts = O.cut_points(df, "v", rows_per_bucket=100)
    assert cuts.buckets >= 200
    cells = O._divided(df, "v", "id", cuts).groupBy("_bucket", "_part").count()
    assert cells.agg(F.max("count")).first()[0] <= 200
