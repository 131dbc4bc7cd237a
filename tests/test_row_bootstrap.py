"""Row bootstraps against draws made one by one."""

import hashlib

import numpy as np
import pytest

from assaymill.operators import row_bootstrap as RB
from assaymill.operators.bootstrap import poisson_steps

ROWS = [(f"p{i}", "big" if i % 3 else "small", 10.0 + i % 7, 10.0 + i % 7 + (i * 37 % 101) / 50 - 1) for i in range(300)]
ROWS += [("lost", "big", None, 1.0), ("alone", None, 5.0, 5.5)]
M = 2**32


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id string, g string, y_true double, y_pred double").repartition(5)


def mix(x):
    x ^= x >> 16
    x = x * RB.MIX[0] % M
    x ^= x >> 13
    x = x * RB.MIX[1] % M
    return x ^ (x >> 16)


def kept(group):
    return [(i, p - t) for i, g, t, p in ROWS if t is not None and (group == "all" or g == group)]


def poisson(u):
    return sum(u >= c for c in poisson_steps())


def test_poisson_weights_of_every_row(frame):
    got = {r.g: r for r in RB.bias_interval_rows(frame, "id", by=["g"], replicates=60).collect()}
    assert set(got) == {"big", "small", None}
    for group, r in got.items():
        stats = []
        for rep in range(60):
            m = s = 0.0
            for i, d in kept(group):
                digest = hashlib.md5(f"42|{i}".encode()).hexdigest()
                w = poisson(mix(int(digest[:8], 16) ^ mix((int(digest[8:16], 16) + rep * RB.GOLDEN) % M)) / M)
                m, s = m + w, s + w * d
            if m:
                stats.append(s / m)
        assert r.replicates == len(stats) and r.n_rows == len(kept(group)) and r.method == "poisson row"
        assert (r.boot_mean, r.ci_low, r.ci_high) == pytest.approx((np.mean(stats), *np.percentile(stats, [2.5, 97.5])))


@pytest.mark.parametrize("block, pieces", [(65536, 1 << 22), (64, 100)])
def test_exact_draws_of_every_row(frame, monkeypatch, block, pieces):
    monkeypatch.setattr(RB, "BLOCK", block)
    monkeypatch.setattr(RB, "DRAWS", pieces)
    r = RB.bias_interval_exact(frame, "id", replicates=40).first()
    rows = [d for _, _, d in sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i, d) for i, d in kept("all"))]
    n, stats = len(rows), []
    for rep in range(40):
        seed, counts = mix(rep + 42), {}
        for j in range(n):
            b = (mix(seed ^ mix(j * RB.GOLDEN % M)) * n >> 32) // block
            counts[b] = counts.get(b, 0) + 1
        picked = []
        for b, k in counts.items():
            inside = rows[b * block : (b + 1) * block]
            picked += [inside[mix(mix(rep + 43) ^ mix((q * RB.GOLDEN % M + b * RB.MIX[0] % M) % M)) * len(inside) >> 32] for q in range(k)]
        assert len(picked) == n
        stats.append(np.mean(picked))
    assert (r.replicates, r.n_rows, r.method) == (40, n, "multinomial row")
    assert (r.boot_mean, r.ci_low, r.ci_high) == pytest.approx((np.mean(stats), *np.percentile(stats, [2.5, 97.5])))


def test_weights_are_poisson():
    w = RB.weights(np.arange(0, M, 4099, dtype=np.uint64).astype(np.uint32))
    assert w.mean() == pytest.approx(1.0, abs=1e-3) and w.var() == pytest.approx(1.0, abs=1e-3)
    edges = np.array([c for c in RB.STEPS if c < M], np.uint32)
    assert (RB.weights(edges) - RB.weights(edges - np.uint32(1)) == 1).all()


def test_no_rows(frame):
    assert RB.bias_interval_rows(frame.where("1 = 0"), "id", by=["g"]).count() == 0


def test_one_row_per_replicate_and_block():
    """Draws are counted in one go per replicate: their rows do not grow with pieces times blocks."""
    n, reps = 100_000, [0, 7]
    for rep, counts in zip(reps, RB.draws_per_block(n, reps, 42, 1024, 1000)):
        j = np.arange(n, dtype=np.uint64)
        u = RB.drawn(RB.mixed(np.array([rep + 42])), (j * np.uint64(RB.GOLDEN)).astype(np.uint32)).astype(np.uint64)
        want = np.bincount(((u * np.uint64(n)) >> np.uint64(32)).astype(np.int64) // 1024)
        assert len(counts) == 98 and counts.sum() == n and (counts == want).all()


def test_exact_draws_of_no_rows(frame):
    assert RB.bias_interval_exact(frame.where("1 = 0"), "id", replicates=3).count() <= 1


def test_weights_are_bytes_in_given_room():
    u = np.arange(0, M, 65537 * 7, dtype=np.uint64).astype(np.uint32).reshape(-1)
    w, above = np.empty(u.shape, np.uint8), np.empty(u.shape, bool)
    assert RB.weights(u, w, above) is w
    assert (w == sum((u >= step).astype(np.uint8) for step in RB.STEPS if step < M)).all()
