"""Helpers shared by the training-data operators.

The Python operators work on Arrow batches: the UTF-8 bytes of a whole batch lie
in one buffer, so numpy handles many documents in one call, without a loop per
document or per token.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.session import shared_folder, written  # noqa: F401

# Bytes of text that numpy works on at once; one longer document is one piece.
PIECE = 1 << 20
# Rows and bytes of one Arrow batch, so that a batch of long documents fits a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = BYTE_CODES[LOWER]


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in set(names)])


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts and ends."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets from 0) of about ``size`` bytes each."""
    data, offsets = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def gathered(batches: Iterator[pa.RecordBatch], size: int, column: str = "_text") -> Iterator[pa.RecordBatch]:
    """Join small batches until their text holds about ``size`` bytes."""
    kept, held = [], 0
    for batch in batches:
        kept.append(batch)
        held += batch.column(column).nbytes
        if held >= size:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, held = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(21, n.bit_length())
        for key, base in (("up", BASE), ("down", _INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def word_table(keep: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes with ``keep``; runs end with their row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = keep[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = LOWER_CODES) -> np.ndarray:
    """64-bit hashes of the byte spans, by prefix sums of a polynomial over random byte codes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * BASE)


# Words of the shingle and language-model contracts: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def words_of(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the piece, and the index in that list where each row's words start."""
    starts, ends = word_table(keep, data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def hash_of_text(text: str) -> int:
    """The hash ``words_of`` gives to one word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
