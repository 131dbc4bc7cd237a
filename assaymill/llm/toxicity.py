"""Toxicity as an ordinal severity: a cumulative-link model over sparse word features.

One weight per word is shared by all thresholds: P(grade > g) is the logistic of
the document's score minus threshold g, with rising thresholds. The expected
severity is the sum of those probabilities over the thresholds.

Training uses at most ``max_train`` labelled documents. Spark finds the features
among their words: it counts, per word, the distinct contexts (word before, word, word after) of either
label, so a passage copied a thousand times counts once, and keeps the words
whose contexts lean to the toxic label beyond doubt. Labels are 0 or 1; a toxic
document's grade follows from how many feature words it holds (``CUTS``). The
weights are then fitted on rows of feature counts.

The features weigh presence (base-2 log of one plus the count), not density, so a long
clean passage around a slur does not dilute it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import BASE, U64, bounded_batches, mix, pieces, signed, text_of, without, words_of, written

OUTPUT = ("severity", "grade", "p_toxic", "n_hits", "toxic")
# Feature words in a toxic document at which its grade rises to 2 and to 3.
CUTS = (2, 5)
MAX_FEATURES = 4096
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, feature, value
# Letters and digits of any script; punctuation, marks and white space part words.
LETTERS = np.ones(256, bool)
LETTERS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


@dataclass(frozen=True)
class SeverityModel:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for each threshold g, one row per document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (toxic, _text) to distinct (word, context) hashes with their label."""
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, data, offsets in pieces(batch.column("_text")):
            words, at = words_of(data, offsets, LETTERS)
            if not len(words):
                continue
            row = np.repeat(np.arange(last - first), np.diff(at))
            edge = U64(1)
            before, after = np.concatenate(([edge], words[:-1])), np.concatenate((words[1:], [edge]))
            starts, ends = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
            before[starts], after[ends] = edge, edge
            own = label[first:last][row].astype(U64)
            context = mix(before * BASE + after) ^ own
            order = np.lexsort((context, words))
            w, c, y = words[order], context[order], own[order]
            new = np.concatenate(([True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(signed(w[new])), pa.array(signed(c[new])), pa.array(y[new].astype(np.int32))], names=["w", "c", "y"])


def find_features(labelled: DataFrame, least_contexts: int = 8) -> np.ndarray:
    """Hashes of the words that lean to the toxic label, at most ``MAX_FEATURES``.

    ``labelled`` has (toxic 0/1, _text). The log-likelihood ratio of a word's
    contexts against the label's share must exceed 30 on the toxic side.
    """
    counts = (
        labelled.mapInArrow(_contexts, "w bigint, c bigint, y int")
        .distinct()
        .groupBy("w")
        .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("f"))
    )
    counts = written(counts)
    total = counts.agg(F.sum("t"), F.sum("f")).first()
    if not total or not total[0] or not total[1]:
        return np.zeros(0, U64)
    share = total[0] / (total[0] + total[1])
    n = F.col("t") + F.col("f")
    gain = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("f") > 0, F.col("f") * F.log(F.col("f") / (n * (1 - share)))).otherwise(0.0))
    top = counts.where((F.col("t") >= least_contexts) & (F.col("t") > 2 * share * n)).withColumn("gain", gain).where("gain > 30").orderBy(F.desc("gain"), "w").limit(MAX_FEATURES)
    return np.sort(np.array([r["w"] for r in top.select("w").collect()], np.int64).view(U64))


def _hits(features: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word that is a feature."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(features, words), len(features) - 1)
    found = np.flatnonzero(features[k] == words)
    return np.searchsorted(at, found, side="right") - 1, k[found]


def _counted(features: np.ndarray):
    """Map (toxic, _text) to (toxic, features of the row, their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column("_text")):
                row, k = _hits(features, *words_of(data, offsets, LETTERS))
                index, value = [], []
                for r in range(last - first):
                    f, c = np.unique(k[row == r], return_counts=True) if len(row) else (np.zeros(0, np.int64),) * 2
                    index.append(f)
                    value.append(c)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(first, last - first), pa.array(index, kind), pa.array(value, kind)], names=["toxic", "k", "n"])

    return run


def fit_ordinal(entries: Entries, width: int, grade: np.ndarray, levels: int, ridge: float = 0.02, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the cumulative-link model, by accelerated gradient steps on sparse rows."""
    n = len(grade)
    row, feature, value = entries
    above = grade[:, None] > np.arange(levels)[None, :]
    share = np.clip(above.mean(axis=0), 1 / (n + 2), 1 - 1 / (n + 2))
    start = -np.log(share / (1 - share))
    # Thresholds are the first plus positive gaps, so they cannot cross.
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    theta = np.concatenate((np.zeros(width), [start[0]], gaps))

    def loss_and_slope(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t0, g = p[:width], p[width], np.exp(np.clip(p[width + 1 :], -20, 5))
        t = np.concatenate(([t0], t0 + np.cumsum(g)))
        score = np.bincount(row, value * w[feature], minlength=n)
        # Survival at each threshold, 1 below the first and 0 beyond the last.
        s = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t - score[:, None], -60, 60))), np.zeros((n, 1))), axis=1)
        rows = np.arange(n)
        p_own = np.maximum(s[rows, grade] - s[rows, grade + 1], 1e-12)
        d = s * (1 - s)
        slope_score = (d[rows, grade] - d[rows, grade + 1]) / p_own
        slope_t = np.zeros(levels)
        for k in range(levels):
            here = np.where(grade == k + 1, -d[:, k + 1] / p_own, 0) + np.where(grade == k, d[:, k + 1] / p_own, 0)
            slope_t[k] = here.sum()
        grad = np.concatenate((ridge * w - np.bincount(feature, value * slope_score[row], minlength=width), [-slope_t.sum()], -g * np.cumsum(slope_t[::-1])[::-1][1:]))
        return -np.log(p_own).sum() + ridge * (w @ w) / 2, grad

    m = v = np.zeros_like(theta)
    for k in range(1, rounds + 1):
        _, grad = loss_and_slope(theta)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    t0, g = theta[width], np.exp(np.clip(theta[width + 1 :], -20, 5))
    return theta[:width], np.concatenate(([t0], t0 + np.cumsum(g)))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20000, id_col: str = "doc_id", text_col: str = "text") -> SeverityModel:
    """Fit the model on ``docs`` with a label (``labels``: id, toxic 0/1).

    Trains on the ``max_train`` labelled documents whose hashed id is smallest: a
    bounded sample, which therefore may be broadcast to find its texts. Null
    labels, ids and texts are no training rows; an id labelled twice takes the
    higher label. Without toxic or without clean rows no word is a feature and
    every text is clean.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = written(known.orderBy(F.xxhash64("_id"), "_id").limit(max_train))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    labelled = written(rows.join(F.broadcast(sample), "_id"))
    features = find_features(labelled.select("toxic", "_text"))
    got = labelled.select("toxic", "_text").mapInArrow(_counted(features), "toxic int, k array<bigint>, n array<bigint>").collect()
    at = np.repeat(np.arange(len(got)), [len(r["k"]) for r in got])
    which = np.array([k for r in got for k in r["k"]], np.int64)
    value = np.log2(1 + np.array([c for r in got for c in r["n"]], float))
    toxic = np.array([row["toxic"] for row in got], int)
    hits = np.array([sum(row["n"]) for row in got], int)
    levels = len(CUTS) + 1
    grade = np.where(toxic > 0, 1 + sum((hits >= c).astype(int) for c in CUTS), 0)
    if not len(features) or len(set(toxic)) < 2:
        return SeverityModel(np.zeros(0, U64), np.zeros(0), np.full(levels, 30.0))
    weights, thresholds = fit_ordinal((at, which, value), len(features), grade, levels)
    return SeverityModel(features, weights, thresholds)


def _scored(model: SeverityModel, text_at: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(text_at)):
                n = last - first
                row, k = _hits(model.features, *words_of(data, offsets, LETTERS))
                cell, count = np.unique(row * max(1, len(model.features)) + k, return_counts=True)
                width = max(1, len(model.features))
                score = np.bincount(cell // width, model.weights[cell % width] * np.log2(1.0 + count) if len(cell) else None, minlength=n)[:n].astype(float)
                p = model.exceed(score)
                cells = np.concatenate((np.ones((n, 1)), p), axis=1) - np.concatenate((p, np.zeros((n, 1))), axis=1)
                hits = np.bincount(row, minlength=n)[:n]
                own = [batch.column(c).slice(first, n) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(p.sum(axis=1)), pa.array(cells.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array(hits), pa.array(p[:, 0] >= 0.5)],
                    names=[*names, *OUTPUT],
                )

    return run


def grade_texts(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """Add severity (expected grade), grade (most likely), p_toxic, n_hits and toxic to every row.

    ``toxic`` holds where a grade above 0 is at least as likely as not. A null or
    empty text has no features. Input columns named like a result are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, [*OUTPUT, "_text"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = "severity double, grade int, p_toxic double, n_hits bigint, toxic boolean"
    return docs.withColumn("_text", text_of(text_col)).mapInArrow(_scored(model, "_text", docs.columns), f"{fields}, {added}")
