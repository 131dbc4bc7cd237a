"""Streams that are stopped and started again go on where they stopped."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assaymill.config import AuditConfig
from assaymill.operators import events as E
from assaymill.streaming import intake as S

SCHEMA = "event_id long, key string, ts timestamp, band string"


def _rows(first, last):
    start = dt.datetime(2024, 1, 1)
    return [(k, None if k % 5 == 0 else "k", start + dt.timedelta(seconds=k), "mild") for k in range(first, last)]


def _feed(spark, folder, first, last):
    spark.createDataFrame(_rows(first, last), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def test_cap_and_limit_go_on_after_a_restart(spark, tmp_path):
    source, cap, limit = str(tmp_path / "in"), str(tmp_path / "cap"), str(tmp_path / "limit")
    for first, last in ((0, 20), (20, 40), (40, 40)):  # the last start has nothing new
        stream = _feed(spark, source, first, last) if first < last else spark.readStream.schema(SCHEMA).parquet(source)
        S.capped(stream, cap, 25)
        S.store(S.limited(stream, 10, 3_600_000), limit)
    capped = spark.read.parquet(f"{cap}/rows")
    assert capped.count() == 40 and capped.where("accepted").count() == 25
    assert {r.event_id for r in capped.where("accepted").collect()} == set(range(25))
    limited = spark.read.parquet(limit)
    want = {r.event_id: r.allowed for r in E.rate_limit(spark.createDataFrame(_rows(0, 40), SCHEMA), limit=10, window_ms=3_600_000).collect()}
    assert {r.event_id: r.allowed for r in limited.collect()} == want


def test_counts_and_routes_go_on_after_a_restart(spark, tmp_path):
    source, counts, routes = str(tmp_path / "in"), str(tmp_path / "counts"), str(tmp_path / "routes")
    for first, last in ((0, 20), (20, 40), (40, 40)):
        stream = _feed(spark, source, first, last) if first < last else spark.readStream.schema(SCHEMA).parquet(source)
        S.counted(stream, counts)
        S.route(stream.withColumn("body", F.lit('{"model_id": "m", "band": "mild"}')).select("event_id", "body"), routes)
    assert [r.n for r in S.newest(spark, counts).collect()] == [40]
    assert S.routed(spark, routes).count() == 40


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A stream opens one store per partition in every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


INTAKE = "event_id long, key string, ts timestamp, body string"


def _bodies(kind, first, last, gap=1):
    start = dt.datetime(2024, 1, 1, 23, 59, 0)
    good = '{"hb": 12.5}' if kind == "feedback" else '{"model_id": "m", "band": "mild", "hb_hat": 12}'
    body = {3: '{"hb": 99}', 7: "[1]", 11: '{"model_id": "m", "band": "x"}', 13: None}
    rows = [(k, None if k % 5 == 0 else f"c{k % 3}", start + dt.timedelta(seconds=k * gap), body.get(k % 17, good)) for k in range(first, last)]
    return rows + ([(10_000 + first, "c0", None, good)] if first == 0 else [])


@pytest.mark.parametrize("kind", ["telemetry", "feedback"])
def test_intake_goes_on_after_a_restart(spark, tmp_path, kind):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cfg = AuditConfig(rate_limit=9, rate_window_ms=40_000, telemetry_daily_cap=40, feedback_daily_cap=30)
    for first, last in ((0, 60), (60, 130), (130, 131)):
        spark.createDataFrame(_bodies(kind, first, last), INTAKE).coalesce(1).write.mode("append").parquet(source)
        S.intake(spark.readStream.schema(INTAKE).parquet(source), out, kind, cfg)
    got = {r.event_id: (r.code, r.error_field) for r in S.taken_in(spark, out).collect()}
    want = {r.event_id: (r.code, r.error_field) for r in E.intake(spark.createDataFrame(_bodies(kind, 0, 131), INTAKE), cfg, kind).collect()}
    assert got == want and len(got) == 132
    assert {c for c, _ in got.values()} == {None, "RATE_LIMITED", "INVALID_BODY"}


def test_idle_clients_leave_the_state(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cfg = AuditConfig(rate_limit=2, rate_window_ms=1000)
    start = dt.datetime(2024, 1, 1)
    for number in range(3):
        rows = [(number * 100 + k, f"client {number} {k}", start + dt.timedelta(hours=number), '{"hb": 10}') for k in range(50)]
        spark.createDataFrame(rows, INTAKE).coalesce(1).write.mode("append").parquet(source)
        S.intake(spark.readStream.schema(INTAKE).parquet(source), out, "feedback", cfg)
    state = spark.read.format("statestore").option("stateVarName", "window").load(f"{out}/_checkpoint")
    clients = {r[0] for r in state.select("key.client").collect()}
    assert clients and all(c.startswith("kclient 2") for c in clients)
    assert S.taken_in(spark, out).where("code IS NULL").count() == 150


def test_counts_replace_only_the_days_of_a_batch(spark, tmp_path):
    source, counts = str(tmp_path / "in"), str(tmp_path / "counts")
    start = dt.datetime(2024, 1, 1)
    written = []
    for number in range(4):
        rows = [(k, "k", start + dt.timedelta(days=number, hours=k - 2), "mild" if k % 2 else None) for k in range(10)]
        written += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        S.counted(spark.readStream.schema(SCHEMA).parquet(source), counts)
    want = E.counts_by_day_and_band(spark.createDataFrame(written, SCHEMA))
    assert sorted(map(str, S.newest(spark, counts).collect())) == sorted(map(str, want.collect()))
    sizes = [spark.read.parquet(f"{counts}/merged/batch={b}").count() for b in range(4) if (tmp_path / "counts" / "merged" / f"batch={b}").exists()]
    assert max(sizes) <= 4  # two days of two bands, however many days came before


def test_a_client_is_answered_in_place_with_one_read_of_its_state():
    """What a client costs is paid once per client and batch: no sorted copies, no second call to read the state."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.value, self.calls, self.timers = None, [], set()

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    handle, step = Handle(), S._WindowLimit(2, 10)
    step.init(handle)
    # Times repeat and come out of order, the larger numbers first; a null number is last.
    first = [((100 + k * 7 % 2500) * 1000 + k % 900, None if k == 40 else 5000 - k % 1250, f"n{k}") for k in range(2500)]
    later = [((2595 + k) * 1000, k, f"m{k}") for k in range(5)]
    got, want, reset, used = {}, {}, None, 0
    for rows, cut in ((first, 1000), (later, 5)):
        frames = [pd.DataFrame(rows[k : k + cut], columns=["us", "event_id", "carried"]) for k in range(0, len(rows), cut)]
        handle.calls.clear()
        (answer,) = step.handleInputRows(("k",), iter(frames), None)
        assert handle.calls == ["get", "update"] and handle.timers == {handle.value[0]}
        assert (answer is frames[0]) == (len(frames) == 1) and len(answer) == len(rows)
        got |= dict(zip(answer["carried"], map(bool, answer["allowed"])))
        for us, number, note in sorted(rows, key=lambda r: (r[0] // 1000, r[1] is None, r[1])):
            if reset is None or us // 1000 > reset:
                reset, used = us // 1000 + 10, 0
            used += 1
            want[note] = used <= 2
    assert got == want and len(got) == 2505


def test_intake_brings_every_field_back(spark, tmp_path):
    """Typed fields, odd keys and times of a stream are those of the batch form, to the last digit."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1, 0, 0, 0, 123457)
    bodies = ['{"model_id": "m", "band": "mild", "hb_hat": 7.300000000000001, "sigma": 0.1, "quality": 1e-300, "latency_ms": 5}', '{"model_id": "\u00e9\\n\\"", "band": "x", "hb_hat": -0.0}', "{", "", None]
    keys = [None, "", 'a"b\\', "line\nend", "\u00e9\U0001f600", "NaN", "null"]
    rows = [(k, keys[k % 7], start + dt.timedelta(microseconds=700001 * k), bodies[k % 5]) for k in range(70)] + [(99, "a", None, bodies[0])]
    cfg = AuditConfig(rate_limit=6, rate_window_ms=30_000)
    spark.createDataFrame(rows, INTAKE).coalesce(1).write.parquet(source)
    S.intake(spark.readStream.schema(INTAKE).parquet(source), out, "telemetry", cfg)
    got = S.taken_in(spark, out)
    judged = E.judged_bodies(spark.createDataFrame(rows, INTAKE), "telemetry", cfg)
    names = ["event_id", "key", "ts", "model_id", "band", "hb_hat", "sigma", "quality", "latency_ms"]
    assert {c: t for c, t in got.dtypes if c in names} == {c: t for c, t in judged.dtypes if c in names}
    assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, judged.select(names).collect()))
    want = {r.event_id: (r.code, r.error_field) for r in E.intake(spark.createDataFrame(rows, INTAKE), cfg, "telemetry").collect()}
    assert {r.event_id: (r.code, r.error_field) for r in got.collect()} == want and len(want) == 71
