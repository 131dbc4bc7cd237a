"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary classifier per bit says on
which side of that split a text lies, from the byte n-grams of its lower-cased
letters. A text gets the language whose codeword is nearest under loss-weighted
decoding: each bit's loss exp(-y * margin) is weighted by how reliably that bit
told apart the training texts of that language. Bits protect each other: a
classifier that fails on one text is outvoted. Texts whose two nearest codewords
are about equally far are flagged as ambiguous.

A bit's classifier is a log-odds table over hashed n-grams, from counts over all
training texts of either side. Tasks count into fixed-size tables, Spark adds
them up, and only languages x buckets numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import BASE, BYTE_CODES, U64, bounded_batches, mix, pieces, text_of, without

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
MAX_LANGUAGES = 512
OUTPUT = ("lang_pred", "score", "ambiguous", "distance")
AMBIGUOUS = 0.1
# ASCII letters, and every byte of a non-ASCII character; anything else is a gap.
_CODES = BYTE_CODES.copy()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CODES[65:91] = _CODES[97:123]
_CODES[~_LETTER] = BYTE_CODES[32]


def codebook(classes: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per class.

    Up to 6 classes: all splits into two sides (2**(classes-1) - 1 of them).
    Beyond: 15 random balanced splits per doubling, from a fixed seed, that keep
    the codewords at least a quarter of their length apart.
    """
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        splits = np.arange(1, 1 << (classes - 1))
        return np.array([[-1.0 if (s >> c) & 1 else 1.0 for s in splits] for c in range(classes)])
    rng = np.random.default_rng(7)
    bits = 15 * int(np.ceil(np.log2(classes)))
    while True:
        code = np.column_stack([rng.permutation(np.where(np.arange(classes) % 2, 1.0, -1.0)) for _ in range(bits)])
        apart = (bits - code @ code.T) / 2
        if apart[~np.eye(classes, dtype=bool)].min() >= bits / 4:
            return code


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: (bucket of every n-gram with a letter, its row)."""
    n = len(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    codes, letter = _CODES[data], _LETTER[data]
    for order in ORDERS:
        if n < order:
            return
        size = n - order + 1
        rolled = np.zeros(size, U64)
        some = np.zeros(size, bool)
        for k in range(order):
            rolled = rolled * BASE + codes[k : k + size]
            some |= letter[k : k + size]
        some &= row[:size] == row[order - 1 :]
        yield (mix(rolled[some] + U64(order)) >> U64(50)).astype(np.int64), row[:size][some]


def _counts(languages: list[str]):
    """Map (lang, _text) to n-gram counts per language, one table per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        place = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            label = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, _, data, offsets in pieces(batch.column("_text")):
                for bucket, row in grams(data, offsets):
                    cells = label[first + row] * BUCKETS + bucket
                    total += np.bincount(cells, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], names=["l", "g", "n"])

    return run


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # buckets x bits
    weights: np.ndarray  # languages x bits; each row adds up to 1

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-odds per bit, number of n-grams) of each row."""
        rows = len(offsets) - 1
        total, n = np.zeros((rows, self.odds.shape[1])), np.zeros(rows)
        for bucket, row in grams(data, offsets):
            if len(row):
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                total[row[starts]] += np.add.reduceat(self.odds[bucket], starts, axis=0)
                n += np.bincount(row, minlength=rows)
        return total / np.maximum(n, 1)[:, None], n

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword, one row per text."""
        loss = np.exp(-self.code[None, :, :] * np.clip(4 * margins, -8, 8)[:, None, :])
        return (loss * self.weights[None, :, :]).sum(axis=2)


def _reliability(model: LanguageModel):
    """Map (lang, _text) to how many texts of each language every bit puts on the right side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((len(model.languages), model.code.shape[1] + 1))
        place = {name: k for k, name in enumerate(model.languages)}
        for batch in batches:
            label = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, last, data, offsets in pieces(batch.column("_text")):
                margins, n = model.margins(data, offsets)
                own = label[first:last][n > 0]
                np.add.at(right[:, 1:], own, margins[n > 0] * model.code[own] > 0)
                np.add.at(right[:, 0], own, 1)
        lang, bit = np.nonzero(right)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bit.astype(np.int32)), pa.array(right[lang, bit])], names=["l", "g", "n"])

    return run


def _gather(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum (l, g, n) rows into a table of the given, bounded, shape."""
    out = np.zeros(shape)
    summed = rows.groupBy("l", "g").agg(F.sum("n").alias("n")).groupBy("l").agg(F.collect_list(F.struct("g", "n")).alias("row"))
    for r in summed.toLocalIterator():
        for g, n in r["row"]:
            out[r["l"], g] = n
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on all rows of ``docs`` that have a language; null texts count as empty.

    At most ``MAX_LANGUAGES`` languages; more raise an error. With none, every text is ``und``.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("_text"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    code = codebook(len(languages))
    counts = _gather(known.mapInArrow(_counts(languages), "l int, g int, n bigint"), (len(languages), BUCKETS))
    share = counts + 0.5
    share /= share.sum(axis=1, keepdims=True)  # each language counts alike, however many texts it has
    odds = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1] if len(languages) > 1 else 0):
        up, down = code[:, bit] > 0, code[:, bit] < 0
        odds[:, bit] = np.log(share[up].mean(axis=0)) - np.log(share[down].mean(axis=0))
    model = LanguageModel(languages, code, odds.astype(np.float32), np.full(code.shape, 1 / code.shape[1]))
    if len(languages) < 2:
        return model
    right = _gather(known.mapInArrow(_reliability(model), "l int, g int, n double"), (len(languages), code.shape[1] + 1))
    accuracy = (right[:, 1:] + 0.5) / (right[:, :1] + 1)
    return LanguageModel(languages, code, model.odds, accuracy / accuracy.sum(axis=1, keepdims=True))


def _predicted(model: LanguageModel, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in pieces(batch.column("_text")):
                own = [batch.column(c).slice(first, last - first) for c in names]
                n = last - first
                if not model.languages:
                    none = pa.nulls(n, pa.float64())
                    yield pa.RecordBatch.from_arrays([*own, pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool)), none], names=[*names, *OUTPUT])
                    continue
                loss = model.losses(model.margins(data, offsets)[0])
                best = loss.argmin(axis=1)
                near = np.sort(loss, axis=1)
                share = np.exp(near[:, :1] - near)
                score = 1 / share.sum(axis=1)
                known = letters[first:last]
                close = (share[:, 1] > 1 - AMBIGUOUS) & known if loss.shape[1] > 1 else np.zeros(n, bool)
                pred = [model.languages[b] if k else "und" for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(pred), pa.array(np.where(known, score, 0.0)), pa.array(close), pa.array(near[:, 0], mask=~known)], names=[*names, *OUTPUT]
                )

    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1), ambiguous and distance to every row.

    A null text, or one without letters of any script, is ``und`` with score 0 and
    a null distance. ``ambiguous``: the second codeword is about as near as the
    first. Equal distances go to the language that sorts first. Input columns named
    like a result are replaced; all others stay.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, [*OUTPUT, "_text", "_letters"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = docs.withColumn("_text", text_of(text_col)).withColumn("_letters", F.col("_text").rlike(r"\p{L}"))
    return rows.mapInArrow(_predicted(model, docs.columns), f"{fields}, lang_pred string, score double, ambiguous boolean, distance double")
