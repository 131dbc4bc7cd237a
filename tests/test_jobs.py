"""Heads, stores, streams, reports and the whole audit."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.config import AuditConfig
from assaymill.operators import events as E
from assaymill.operators import heads as H
from assaymill.operators import sweep as W
from assaymill.operators import training as T
from assaymill.plans.evaluate import evaluate
from assaymill.session import shared_folder
from assaymill.sources import feature_store, predictions, reports
from assaymill.sources.events import read_events, stream_events
from assaymill.streaming import intake as S


def planted(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = 12 + 1.5 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.1, n)
    rows = [
        (i, "ab"[i % 2], "MF"[i % 2], ("train", "train", "val", "test")[i % 4], float(v), row.tolist())
        for i, (row, v) in enumerate(zip(x, y))
    ]
    return spark.createDataFrame(rows, "id long, site string, sex string, split string, y double, features array<double>")


def test_head_uses_test_once(spark, tmp_path):
    rows = planted(spark)
    head = H.choose(rows, "regression", (0.001, 10.0))
    assert head.regularisation == 0.001
    got = H.score_test_once(head, rows, str(tmp_path), "r1").first()
    assert got.n == 75 and got.mae < 0.2
    with pytest.raises(H.TestReadTwice):
        H.score_test_once(head, rows, str(tmp_path), "r1")


@pytest.mark.parametrize("name", ["binary", "severity", "ordinal"])
def test_class_heads_follow_the_signal(spark, name):
    rows = planted(spark)
    head = H.fit(rows.where("split = 'train'"), name)
    r = H.score(head, rows.where("split = 'val'")).first()
    assert r.pearson_r > 0.6


def test_cross_site(spark):
    out = H.cross_site(planted(spark), "regression", [("a", "b"), ("b", "a")])
    assert {r.fold: r["count"] for r in out.groupBy("fold").count().collect()} == {"a->b": 150, "b->a": 150}


def test_standardise_fits_on_train(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (100.0, "test")], "f double, split string")
    assert [r.f for r in T.standardise(df, ["f"]).collect()] == [-1.0, 1.0, 98.0]
    dead = spark.createDataFrame([(5.0, "train"), (5.0, "train")], "f double, split string")
    assert [r.f for r in T.standardise(dead, ["f"]).collect()] == [0.0, 0.0]


def test_class_weights_mean_one(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (2,)], "k int")
    w = {r.klass: r for r in T.class_weights(df, F.col("k"), 4).collect()}
    assert sum(w[k].n * w[k].weight for k in w) / 4 == pytest.approx(1.0)
    assert w[1].n == 0 and w[2].weight > w[0].weight


def test_feature_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "patient_id string, f double")
    path, mark = str(tmp_path / "store"), feature_store.config_fingerprint({"v": 1})
    feature_store.save(df, path, "colour", "palpebral", "raw", mark)
    feature_store.save(df, path, "colour", "palpebral", "balanced", mark)
    assert feature_store.load(spark, path, "colour", "palpebral", "raw", mark, df).count() == 2
    with pytest.raises(LookupError):
        feature_store.load(spark, path, "colour", "palpebral", "raw", "other")
    with pytest.raises(LookupError):
        feature_store.load(spark, path, "colour", "palpebral", "raw", mark, df.limit(1))


def test_prediction_readers(spark, tmp_path):
    rows = [{"hb_true": 10.0, "prediction": 11.0}, {"hb_true": None, "prediction": 9.0}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    (tmp_path / "p.csv").write_text("hb,hb_hat,confidence\n10,11,NaN\n12,x,0.5\n")
    a = predictions.read_predictions(spark, str(tmp_path / "p.json"))
    assert {"y_true", "y_pred", "sex", "site"} <= set(a.columns) and a.first().sex == "F"
    b = predictions.read_predictions(spark, str(tmp_path / "p.csv")).collect()
    assert b[0].confidence is None and b[1].y_pred is None and b[0].y_true == 10.0
    with pytest.raises(ValueError):
        predictions.read_predictions(spark, str(tmp_path / "p.xlsx"))


def test_audit_says_what_is_missing(spark):
    rng = np.random.default_rng(0)
    t = rng.uniform(9, 16, 60)
    rows = [(i, float(a), float(a + e)) for i, (a, e) in enumerate(zip(t, rng.normal(0, 0.8, 60)))]
    bare = evaluate(spark.createDataFrame(rows, "id long, y_true double, y_pred double"))
    assert "coverage" not in bare and "fairness" not in bare
    cal = bare["calibration"].first()
    assert cal.available is False and cal.reason
    assert {r.site for r in bare["regression"].collect()} == {"Unknown", "pooled"}


def test_coverage_ranks_by_uncertainty(spark):
    rows = [(i, 10.0, 10.0 + i * 0.1, 1.0 - i * 0.01, 5.0 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, y_true double, y_pred double, confidence double, ita double")
    out = evaluate(df)
    cov = {r.target: r.mae for r in out["coverage"].collect()}
    assert cov[0.7] < cov[1.0]
    assert out["fairness"].first().available


def events_folder(spark, tmp_path, n=400, files=4):
    rows = [(i, f"2024-01-0{1 + (i * 7) // 900} 0{(i // 60) % 10}:{i % 60:02d}:{(i * 13) % 60:02d}", i % 7, "view", float(i % 30), "{}") for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df = df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    folder = str(tmp_path / "in")
    df.orderBy("ts", "event_id").coalesce(1).write.option("maxRecordsPerFile", n // files).parquet(folder)
    return folder


def test_streams_equal_their_batch_twins(spark, tmp_path):
    folder = events_folder(spark, tmp_path)

    def shape(df):
        return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"), F.lit("mild").alias("band"))

    batch = shape(read_events(spark, folder))
    stream = lambda: shape(stream_events(spark, folder, files_per_trigger=1))
    out = str(tmp_path / "days")
    S.counted(stream(), out)
    assert sorted(S.newest(spark, out).collect()) == sorted(E.counts_by_day_and_band(batch).collect())
    out = str(tmp_path / "cap")
    S.capped(stream(), out, 90)
    got = spark.read.parquet(f"{out}/rows").groupBy(E.utc_day(F.col("ts")).alias("d")).agg(F.count_if("accepted").alias("n"))
    want = E.daily_cap(batch, 90).groupBy(E.utc_day(F.col("ts")).alias("d")).agg(F.count_if("accepted").alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())
    out = str(tmp_path / "limit")
    S.store(S.limited(stream(), 4, 3_600_000, late="10 days"), out)
    got = {r.event_id: r.allowed for r in spark.read.parquet(out).select("event_id", "allowed").collect()}
    assert len(got) == 400 and not all(got.values())


def test_arrival_time_is_ours(spark):
    df = spark.createDataFrame([(1, "1999-01-01")], "event_id long, ts string")
    assert S.stamped(df).first().ts.year > 2020


@pytest.mark.parametrize(
    "body, code, field",
    [
        ('{"model_id":"m-1","band":"mild","hb_hat":11.5,"junk":1}', None, None),
        ('{"model_id":"m-1","band":"fine"}', "INVALID_BODY", "band"),
        ('{"model_id":"M 1","band":"mild"}', "INVALID_BODY", "model_id"),
        ('{"model_id":"m","band":"mild","hb_hat":40}', "INVALID_BODY", "hb_hat"),
        ('{"model_id":"m","band":"mild","hb_hat":"12"}', "INVALID_BODY", "hb_hat"),
        ('{"model_id":"m","band":"mild","sigma":null}', "INVALID_BODY", "sigma"),
        ('{"model_id":"m","band":"mild","latency_ms":1.5}', "INVALID_BODY", "latency_ms"),
        ("[1]", "INVALID_BODY", None),
        ("{", "INVALID_BODY", None),
        ('{"p":"' + "x" * 1100 + '"}', "PAYLOAD_TOO_LARGE", None),
    ],
)
def test_event_contract(spark, body, code, field):
    df = spark.createDataFrame([(1, "k", body)], "event_id long, key string, body string").withColumn("ts", F.current_timestamp())
    r = E.parsed_fields(df.withColumn("e", E.body_error(F.col("body"))))
    r = r.withColumn("f", F.when(F.col("e").isNull(), E.field_error({n: F.col(f"{n}_given") for n in E.RANGES}))).first()
    assert (r.e or (r.f and "INVALID_BODY")) == code and r.f == field


def test_intake_order_and_caps(spark):
    ok = '{"model_id":"m","band":"mild"}'
    rows = [(i, "k", ok) for i in range(31)] + [(100 + i, f"u{i}", ok) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, key string, body string").withColumn("ts", F.to_timestamp(F.lit("2024-05-01 10:00:00")))
    out = E.intake(df, AuditConfig(telemetry_daily_cap=35))
    got = {r.event_id: r.code for r in out.collect()}
    assert got[30] == "RATE_LIMITED" and sum(c is None for c in got.values()) == 35


def test_sweep_rules(spark):
    rows = [("deep / forniceal", 1.9837, 0.1), ("deep / palpebral", 1.9837, 0.1), ("colour / forniceal / raw", 1.99, 0.2), ("bad", float("nan"), float("nan"))]
    df = spark.createDataFrame(rows, "label string, val_mae double, val_r2 double")
    w = W.winner(df).first()
    assert (w.label, w.gap, w.near_tie) == ("deep / forniceal", 0.0, True)
    assert W.winner(df, "r2").first().label == "colour / forniceal / raw"
    assert [r["rank"] for r in W.ranked(df).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert W.grid(spark).count() == 15 and W.extraction_keys(W.grid(spark)).count() == 15
    asked = spark.createDataFrame([("deep/palpebral",), ("nope",)], "term string")
    assert [r.label for r in W.chosen(W.grid(spark), asked).collect()] == ["deep / palpebral"]
    assert [r.term for r in W.unmatched_terms(W.grid(spark), asked).collect()] == ["nope"]


def test_manifest(spark):
    df = reports.with_manifest(spark.range(1), reports.settings_of(AuditConfig()), "synthetic").first()
    assert len(df.fingerprint) == 64 and df.corpus == "synthetic" and df.generated_at is not None
    assert shared_folder(spark) != shared_folder(spark)
