"""Fits that share their passes, against direct solutions."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assaymill.config import AuditConfig
from assaymill.operators import heads as H
from assaymill.operators import many_fits as M

CFG = AuditConfig()


def data(n=600, d=5, seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * [1, 5, 0.1, 2, 0][:d] + [0, 30, 1, -4, 7][:d]
    y = 11 + 1.2 * x[:, 0] - 0.2 * (x[:, 1] - 30) + r.standard_t(3, n)
    group = np.where(np.arange(n) % 3 == 0, "val", "train")
    x[::17, 2] = np.nan
    return x, y, group


@pytest.fixture(scope="module")
def frame(spark):
    x, y, g = data()
    rows = [(i, "MF"[i % 2], str(g[i]), float(y[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    rows += [(1000, "M", "train", None, [0.0] * 5), (1001, None, "train", 5.0, None)]
    return spark.createDataFrame(rows, "id long, sex string, split string, y double, features array<double>").repartition(4)


def direct(columns, lam):
    x, y, g = data()
    x = x[:, list(columns)]
    use = (g == "train") & np.isfinite(x).all(axis=1)
    x, y = x[use], y[use]
    mean, sd = x.mean(0), x.std(0)
    z = np.where(sd > 1e-12, (x - mean) / np.where(sd > 1e-12, sd, 1), 0)
    return z, y, mean, sd, lam, use.sum()


@pytest.mark.parametrize("lam", [0.001, 1.0])
def test_ridge_is_closed_form(frame, lam):
    specs = [M.Spec("all", "ridge", lam, (0, 1, 2, 3, 4)), M.Spec("two", "ridge", lam, (3, 0))]
    for spec, got in zip(specs, M.fit_many(frame, specs)):
        z, y, mean, sd, _, n = direct(spec.columns, lam)
        w = np.linalg.lstsq(z.T @ z / n + lam * np.eye(z.shape[1]), z.T @ (y - y.mean()) / n, rcond=None)[0]
        raw = np.where(sd > 1e-12, w / np.where(sd > 1e-12, sd, 1), 0)
        assert got.n == n and got.rounds == 0
        assert np.allclose(got.coef[1:, 0], raw, atol=1e-9)
        assert got.coef[0, 0] == pytest.approx(y.mean() - raw @ mean, abs=1e-8)


def gradient(head, got, lam):
    """Of the mean loss at the solution, in standardised coordinates."""
    z, y, mean, sd, _, n = direct(got.spec.columns, lam)
    w = got.coef[1:] * np.where(sd > 1e-12, sd, 1)[:, None]
    b = got.coef[0] + mean @ got.coef[1:]
    out = z @ w + b
    if head == "regression":
        r = np.clip(out[:, 0] - y, -1, 1)[:, None]
    else:
        e = np.exp(out - out.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        if head == "ordinal":
            s = np.exp(-0.5 * ((y[:, None] - np.array(CFG.centres)) / CFG.soft_sigma) ** 2)
            r = p - s / s.sum(1, keepdims=True)
        else:
            x, _, g = data()
            sex = np.array(["MF"[i % 2] for i in range(len(g))])[(g == "train") & np.isfinite(x[:, list(got.spec.columns)]).all(1)]
            cut = np.where(sex == "M", 13.0, 12.0)
            label = (y < 13).astype(int) if head == "binary" else np.where(y < 7, 3, np.where(y < 9, 2, np.where(y < cut, 1, 0)))
            present = sorted(set(label))
            count = np.array([(label == k).sum() for k in present])
            weight = 1 / (count / n + 1e-6)
            weight = weight / (count / n * weight).sum()
            at = np.searchsorted(present, label)
            r = (p - np.eye(len(present))[at]) * weight[at][:, None]
    return np.vstack([r.mean(0), z.T @ r / n + lam * w])


@pytest.mark.parametrize("head", ["regression", "binary", "severity", "ordinal"])
def test_gradient_vanishes_at_the_solution(frame, head):
    specs = [M.Spec("a", head, 0.01, (0, 1, 3)), M.Spec("b", head, 0.1, (0, 1, 2, 3, 4))]
    for spec, got in zip(specs, M.fit_many(frame, specs)):
        assert got.converged and 0 < got.rounds < 60
        assert np.abs(gradient(head, got, spec.regularisation)).max() < 3e-4


def test_binary_agrees_with_spark_ml(frame):
    got = M.fit_many(frame, [M.Spec("a", "binary", 0.1, (0, 1))])[0]
    train = frame.where("split = 'train' AND y IS NOT NULL AND features IS NOT NULL").withColumn("label", (F.col("y") < 13).cast("int"))
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    raw = {k: 1 / (v / sum(n.values()) + 1e-6) for k, v in n.items()}
    mean = sum(raw[k] * n[k] for k in n) / sum(n.values())
    _, _, mean_x, sd, *_ = direct((0, 1), 0.1)
    scaled = F.array(*[(F.col("features")[k] - float(mean_x[k])) / float(sd[k]) for k in range(2)])
    weighted = train.withColumns({"x": array_to_vector(scaled), "w": F.when(F.col("label") == 1, raw[1] / mean).otherwise(raw[0] / mean)})
    model = LogisticRegression(featuresCol="x", weightCol="w", family="multinomial", regParam=0.1, maxIter=300, tol=1e-12, standardization=False).fit(weighted)
    want = model.coefficientMatrix.toArray()
    assert np.allclose((got.coef[1:, 1] - got.coef[1:, 0]) * sd, want[1] - want[0], atol=1e-4)


def test_two_level_merge_gives_the_same_sums(frame, monkeypatch):
    specs = [M.Spec("a", "severity", 0.01, (0, 1, 3)), M.Spec("r", "ridge", 0.01, (0, 1, 2))]
    plain = M.fit_many(frame, specs)
    monkeypatch.setattr(M, "COLLECT_BYTES", 0)
    monkeypatch.setattr(M, "SLAB", 5)
    again = M.fit_many(frame, specs)
    for a, b in zip(plain, again):
        assert np.allclose(a.coef, b.coef, atol=1e-6)


def test_scores_and_predictions_agree(frame):
    solutions = M.fit_many(frame, [M.Spec(h, h, 0.01, (0, 3, 1)) for h in H.KINDS_OF_HEAD])
    val = frame.where("split = 'val'")
    for s, got in zip(solutions, M.score_many(val, solutions)):
        r = H.score(H.Head(s.spec.head, s), val).first()
        assert got["n"] == r.n
        for m in ("mae", "rmse", "r2", "bias"):
            assert got[m] == pytest.approx(r[m], abs=1e-9)
    assert M.score_many(val.where("1 = 0"), solutions)[0] == {"n": 0, "mae": None, "rmse": None, "bias": None, "r2": None}


def test_a_group_without_rows_is_an_error(frame):
    with pytest.raises(ValueError, match="no training row"):
        M.fit_many(frame, [M.Spec("x", "ridge", 0.1, (0,), "nowhere")])


def test_sweep_needs_all_features(frame):
    with pytest.raises(KeyError):
        H.sweep_grid(frame, {"deep/palpebral/balanced": (0,)})
