"""Distributed orderings and limits against brute force, with heavy ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.operators import coverage as V
from assaymill.operators import events as E
from assaymill.operators import integrity as I
from assaymill.operators import ordered as O
from assaymill.operators import splits as S


def skewed(spark, n=4000, seed=3):
    """A third of all rows in one group share one value."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35
        value = 0.25 if hot else round(rng.random(), 3)
        rows.append((f"r{i}", "hot" if hot else rng.choice("abc"), value, rng.random() * 3))
    return rows, spark.createDataFrame(rows, "id string, g string, v double, e double").repartition(6)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_rank(spark, by):
    rows, df = skewed(spark)
    got = {r.id: r.rk for r in O.average_rank(df, "v", "id", "rk", by, rows_per_bucket=200).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if by else "", []).append(r)
    for members in groups.values():
        values = np.array([r[2] for r in members])
        for r in members:
            less, same = (values < r[2]).sum(), (values == r[2]).sum()
            assert got[r[0]] == less + (same + 1) / 2


def test_frequent_values_get_their_own_bucket(spark):
    _, df = skewed(spark)
    cuts = O.cut_points(df, "v", rows_per_bucket=200)
    assert any(cuts.splits[i] == 0.25 for i in cuts.frequent)
    sizes = {r["_bucket"]: r["count"] for r in cuts.assign(df, "v").groupBy("_bucket").count().collect()}
    assert max(n for b, n in sizes.items() if b not in cuts.frequent) < 500


@pytest.mark.parametrize("by", [[], ["g"]])
def test_risk_coverage(spark, by):
    import hashlib

    rows, df = skewed(spark)
    df = df.withColumns({"y_true": F.lit(0.0), "y_pred": F.col("e")})
    got = {}
    for r in V.risk_coverage(df, "v", "id", by=by, rows_per_bucket=150).collect():
        got.setdefault(r["g"] if by else "", {})[r.point] = r
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if by else "", []).append(r)
    for g, members in groups.items():
        members.sort(key=lambda r: (r[2], hashlib.md5(r[0].encode()).hexdigest()))
        n = len(members)
        for i, f in enumerate(np.linspace(1.0, 0.1, 20)):
            k = max(1, round(f * n))
            assert got[g][i].k == k
            assert got[g][i].mae == pytest.approx(np.mean([r[3] for r in members[:k]]))
            assert got[g][i].threshold == members[k - 1][2]


def test_exact_quantiles(spark):
    rows, df = skewed(spark)
    got = {r.g: r for r in O.exact_quantiles(df, "v", "id", {"p05": 0.05, "med": 0.5, "p99": 0.99}, ["g"], 100).collect()}
    for g in "abc":
        values = [r[2] for r in rows if r[1] == g]
        assert (got[g].p05, got[g].med, got[g].p99) == pytest.approx(tuple(np.percentile(values, [5, 50, 99])))


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([("a", 1.0)], "id string, v double")
    assert O.exact_quantiles(one, "v", "id", {"med": 0.5}).first().med == 1.0
    assert O.average_rank(one, "v", "id", "rk").first().rk == 1.0
    assert O.average_rank(one.where("v > 2"), "v", "id", "rk").count() == 0


def brute_limit(events, limit, window):
    allowed, state = {}, {}
    for key, ms, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        reset, used = state.get(key, (None, 0))
        if reset is None or ms > reset:
            reset, used = ms + window, 0
        used += 1
        state[key] = (reset, used)
        allowed[i] = used <= limit
    return allowed


@pytest.mark.parametrize("seed, window, span, fan", [(1, 50, 20_000, 256), (2, 1000, 9_000, 2), (3, 7, 60_000, 3), (4, 7, 60_000, 7)])
def test_rate_limit(spark, seed, window, span, fan, monkeypatch):
    monkeypatch.setattr(E, "FAN", fan)  # several levels of composed chunks
    rng = random.Random(seed)
    # One key has most of the events, some at the same millisecond; one has long gaps.
    events = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(span), i) for i in range(3000)]
    events += [("gaps", j * window * 40 + rng.randrange(3), 10_000 + j) for j in range(60)]
    df = spark.createDataFrame(events, "key string, ms long, event_id long").select(
        "key", "event_id", F.timestamp_millis("ms").alias("ts")
    )
    got = {r.event_id: r.allowed for r in E.rate_limit(df.repartition(5), limit=3, window_ms=window).collect()}
    assert got == brute_limit(events, 3, window)


def test_daily_cap_with_used(spark):
    rows = [(i, f"2024-01-0{1 + i % 2} 00:00:{i % 60:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts"))
    used = spark.createDataFrame([("2024-01-01", 30)], "day string, n long")
    got = {r.event_id: r.accepted for r in E.daily_cap(df, 50, used=used).collect()}
    for day, room in ((0, 20), (1, 50)):
        ids = sorted((i for i in range(200) if i % 2 == day), key=lambda i: (rows[i][1], i))
        assert [got[i] for i in ids] == [True] * room + [False] * (100 - room)


@pytest.mark.parametrize("cap", [0, 1, 700, 1499, 5000])
def test_daily_cap_inside_one_minute(spark, cap):
    rng = random.Random(cap)
    # All of a day's rows in one minute, many of them in one millisecond and out of order.
    rows = [(i, 1_700_000_000_000 + (500 if rng.random() < 0.4 else rng.randrange(1000))) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, ms long").select("event_id", F.timestamp_millis("ms").alias("ts")).repartition(4)
    got = {r.event_id for r in E.daily_cap(df, cap).where("accepted").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:cap]}


@pytest.mark.parametrize("strata", [[], ["s"]])
def test_kfold_invariants(spark, strata):
    df = spark.createDataFrame([(f"p{i}", "a" if i % 3 else "b") for i in range(103)], "id string, s string")
    folds = S.kfold(df.union(df), "id", strata=strata)
    assert I.split_leakage(folds, "id").count() == 0
    rows = folds.collect()
    assert len(rows) == 103 * 5
    tests = [r.id for r in rows if r.split == "test"]
    assert sorted(tests) == sorted(f"p{i}" for i in range(103))
    assert all(any(r.fold == k and r.split == s for r in rows) for k in range(5) for s in ("train", "val", "test"))


def test_stratified_split_matches_dealing(spark):
    rng = random.Random(0)
    people = [(f"x/{i}", rng.choices(["mild", "normal", "severe"], [5, 3, 1])[0]) for i in range(137)]
    df = spark.createDataFrame(people, "id string, s string")
    import hashlib

    got = {r.id: r.split for r in S.stratified_split(df, "id", "s").collect()}
    buckets = {}
    for pid, s in people:
        buckets.setdefault(s, []).append(pid)
    for s in buckets:
        buckets[s].sort(key=lambda p: hashlib.md5(f"42|{p}".encode()).hexdigest())
    order, n, quota = sorted(buckets), len(people), round(137 * 0.2)
    want, val, test = dict.fromkeys((p for p, _ in people), "train"), 0, 0
    taken = {s: 0 for s in order}
    for i in range(n):
        s = order[i % len(order)]
        if taken[s] == len(buckets[s]):
            continue
        pid, taken[s] = buckets[s][taken[s]], taken[s] + 1
        if val < quota:
            want[pid], val = "val", val + 1
        elif test < quota:
            want[pid], test = "test", test + 1
    assert got == want


def test_site_holdout(spark):
    df = spark.createDataFrame([("a/1", "a"), ("a/2", "a"), ("b/1", "b"), ("c/1", " "), ("d/1", None)], "id string, site string")
    got = {(r.fold, r.id): r.split for r in S.site_holdout(df, "id", "site", ["a", "b"]).collect()}
    assert got == {("a->b", "a/1"): "train", ("a->b", "a/2"): "train", ("a->b", "b/1"): "test",
                   ("b->a", "a/1"): "test", ("b->a", "a/2"): "test", ("b->a", "b/1"): "train"}
    assert {r.id: r.reason for r in S.without_site(df, "id", "site").collect()} == {"c/1": "blank", "d/1": "missing"}


def test_ranks_and_colours_take_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    from assaymill.operators import pixels as X

    monkeypatch.setattr(X, "ROWS_PER_TASK", 10)
    px = spark.range(400).selectExpr("id % 5 AS image_id", "cast(id % 7 as int) AS r", "cast(id % 11 as int) AS g", "cast(id % 3 as int) AS b", "id % 2 = 0 AS in_roi")
    counts = X.colour_counts(px)
    moved = X.balanced(counts)
    assert "REPARTITION_BY_NUM" in counts._jdf.queryExecution().toString()
    assert moved.agg({"n": "sum"}).first()[0] == 400
    rows = spark.range(300).selectExpr("id", "cast(id % 50 as double) AS v")
    ranked = O.average_rank(rows, "v", "id", "rk", rows_per_bucket=10)
    assert "REPARTITION_BY_NUM" in ranked._jdf.queryExecution().toString()
    assert {(r.v, r.rk) for r in ranked.collect()} == {(float(v), 6 * v + 3.5) for v in range(50)}
