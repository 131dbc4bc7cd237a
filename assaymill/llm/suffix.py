"""Exact-substring removal by bucket-pointer refinement.

A suffix array orders suffixes by sorting them into buckets by their first q
bytes and then refining every bucket by the bucket identifiers found at later
offsets; a suffix alone in its bucket is finished. Two things make this work on
a cluster:

* Bucket identifiers are fingerprints of the prefix they stand for. The bucket
  of a suffix at depth 2d is made of its bucket at depth d and the bucket at
  depth d of the suffix d bytes later; the updates of one round are reused by the
  next: depths 5, 25, 50, 100, 200, 400.
* Only suffixes at anchors enter the distributed sort. The anchor of a
  ``length``-byte string is the position of the smallest depth-25 bucket in it.
  Equal strings have equal anchors, so every string starts in the range of its
  anchor and is compared only there. About one position in 190 is an anchor.

A range of starting points is then refined instead of a single one: if the text
spanned by all its strings lies in a bucket with another member, all of them are
repeated; if the bytes common to all its strings are alone in their bucket, none
is; otherwise the range is divided (whole range, then cells of 64, 8 and 1). The
last division is one string, so the result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import BASE, BYTE_CODES, U64, bounded_batches, buffers, mix, shared_folder, signed, text_of, without, written

QGRAM = 25
CELLS = (64, 8, 1)
OUTPUT = ("n_bytes", "n_removed", "n_spans", "kept")
_STEP = 1 << 18
_PLACE = ("lo", "width", "back", "anchor", "member")


def _depths(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Bucket identifiers of every position at each depth up to ``length``."""

    def refine(ids: np.ndarray, depth: int, times: int) -> np.ndarray:
        n = len(ids) - depth * (times - 1)
        if n <= 0:
            return np.zeros(0, U64)
        out = ids[:n].copy()
        for k in range(1, times):
            out *= BASE
            out += ids[depth * k : depth * k + n]
        out ^= out >> U64(29)
        out *= U64(0xBF58476D1CE4E5B9)
        out ^= out >> U64(32)
        return out

    five = refine(BYTE_CODES[data], 1, 5)
    found = {QGRAM: refine(five, 5, 5)}
    depth = QGRAM
    while depth * 2 <= length:
        found[depth * 2] = refine(found[depth], depth, 2)
        depth *= 2
    if depth < length:
        n = max(0, len(found[depth]) - (length - depth))
        found[length] = mix(found[depth][:n] * BASE + found[depth][len(found[depth]) - n :])
    return found


def _identify(depths: dict[int, np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit identifiers, as two numbers, of spans of QGRAM bytes up to twice the largest depth."""
    out = np.zeros((len(start), 2), U64)
    levels = sorted(depths)
    level = np.searchsorted(levels, size, side="right") - 1
    for k, depth in enumerate(levels):
        at = np.flatnonzero(level == k)
        if len(at):
            ids = depths[depth]
            a, b = ids[start[at]], ids[start[at] + size[at] - depth]
            tag = size[at].astype(U64) * BASE
            out[at, 0] = mix(a * BASE + b + tag)
            out[at, 1] = mix(a ^ mix(b + tag))
    return out


def _anchors(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the depth-25 buckets of a stretch: (lo, hi, anchor) of each range of string starts."""
    width = length - QGRAM + 1
    n = len(first)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    # 40 bits of the bucket decide, then the leftmost position.
    key = (first & ~U64((1 << 24) - 1)) | np.arange(n, dtype=U64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = key
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - width + 1], left[width - 1 : n])
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    lo = np.concatenate(([0], change))
    hi = np.concatenate((change - 1, [len(low) - 1]))
    return lo, hi, (low[lo] & U64((1 << 24) - 1)).astype(np.int64)


def _stretches(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, begin, end) of stretches of at most ``_STEP`` string starts."""
    for row in np.flatnonzero(np.diff(offsets) >= length):
        begin, end = int(offsets[row]), int(offsets[row + 1])
        while end - begin >= length:
            yield int(row), begin, min(end, begin + _STEP + length - 1)
            begin += _STEP


def _groups(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Gather stretches into contiguous byte ranges: (begin, end, rows, their starts and ends)."""
    rows: list[tuple[int, int, int]] = []
    for one in _stretches(offsets, length):
        if rows and one[2] - rows[0][1] > _STEP + length:
            yield rows[0][1], rows[-1][2], np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
            rows = []
        rows.append(one)
    if rows:
        yield rows[0][1], rows[-1][2], np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])


def _ranges(length: int):
    """Map batches (_row, _text) to one row per range of string starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            for begin, end, rows, spans in _groups(offsets, length):
                depths = _depths(data[begin:end], length)
                parts = []
                for row, (a, b) in zip(rows, spans):
                    a, b = a - begin, b - begin
                    lo, hi, at = _anchors(depths[QGRAM][a : b - QGRAM + 1], length)
                    parts.append((np.full(len(lo), row), lo + a, hi + a, at + a))
                row, lo, hi, at = (np.concatenate(x) for x in zip(*parts))
                full = _identify(depths, lo, hi - lo + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").take(pa.array(row)),
                        pa.array(lo + begin - offsets[row]),
                        pa.array((hi - lo).astype(np.int32)),
                        pa.array((at - lo).astype(np.int32)),
                        pa.array(depths[QGRAM][at].view(np.int64)),
                        pa.array(signed(full[:, 0])),
                        pa.array(signed(full[:, 1])),
                    ],
                    names=["_row", *_PLACE[:-1], "f0", "f1"],
                )

    return run


def _cells(length: int, size: int):
    """Divide the open ranges of each text into cells of ``size`` string starts, counted back from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            spans = batch.column("open")
            text = np.repeat(np.arange(len(batch)), np.diff(spans.offsets.to_numpy()))
            inner = spans.flatten()
            for k in range(0, len(text), 512):  # a bounded number of bytes at a time
                part = inner.slice(k, 512)
                lo, width, back = (part.field(c).to_numpy().astype(np.int64) for c in ("lo", "width", "back"))
                own = text[k : k + 512]
                begin = offsets[own] + lo
                depths = _depths(np.concatenate([data[b : b + w + length] for b, w in zip(begin, width)]), length)
                base = np.cumsum(width + length) - (width + length)
                # A string starts between ``least`` and ``back`` bytes before the anchor.
                least = back - width
                counts = back // size - least // size + 1
                row = np.repeat(np.arange(len(part)), counts)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + (least // size)[row]
                near = np.maximum(cell * size, least[row])
                far = np.minimum(cell * size + size - 1, back[row])
                start, stop = back[row] - far, back[row] - near
                core = _identify(depths, base[row] + back[row] - cell * size, np.full(len(row), length - size + 1))
                full = _identify(depths, base[row] + start, stop - start + length)
                # Ranges at the rim of a cell are equal only with the same extent.
                full[:, 0] = mix(full[:, 0] + near.astype(U64) * BASE + far.astype(U64))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").take(pa.array(own[row])),
                        pa.array(lo[row] + start),
                        pa.array((stop - start).astype(np.int32)),
                        pa.array(far.astype(np.int32)),
                        part.field("anchor").take(take),
                        part.field("member").take(take),
                        pa.array(cell.astype(np.int32)),
                        *(pa.array(signed(ids[:, c])) for ids in (core, full) for c in (0, 1)),
                    ],
                    names=["_row", *_PLACE, "cell", "c0", "c1", "f0", "f1"],
                )

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the spans out of each text."""
    for batch in batches:
        data, offsets = buffers(batch.column("_text"))
        spans = batch.column("spans")
        at = spans.offsets.to_numpy()
        inner = spans.flatten()
        begins, ends = inner.field("lo").to_numpy(), inner.field("hi").to_numpy()
        kept, removed, runs = [], np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for k in range(len(batch)):
            text = data[offsets[k] : offsets[k + 1]]
            if at[k] == at[k + 1]:
                kept.append(text.tobytes())
                continue
            order = np.argsort(begins[at[k] : at[k + 1]], kind="stable")
            begin, reach = begins[at[k] : at[k + 1]][order], np.maximum.accumulate(ends[at[k] : at[k + 1]][order])
            new = np.concatenate(([True], begin[1:] > reach[:-1]))
            first, last = begin[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]
            runs[k], removed[k] = len(first), (last - first).sum()
            edges = np.concatenate(([0], np.column_stack((first, last)).ravel(), [len(text)]))
            kept.append(b"".join(text[a:b].tobytes() for a, b in edges.reshape(-1, 2)))
        names = [n for n in batch.schema.names if n not in ("_text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())],
            names=[*names, *OUTPUT],
        )


def _spans(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("_row", "lo", (F.col("lo") + F.col("width") + length).alias("hi"))


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """Spans (_row, lo, hi) of ``texts`` (_row, _text) that repeated strings cover; they may overlap."""
    place = "_row bigint, lo bigint, width int, back int, anchor bigint"
    here = F.struct("_row", "lo", "width", "back")
    ranges = written(texts.select("_row", "_text").mapInArrow(_ranges(length), place + ", f0 bigint, f1 bigint"))
    # First buckets: the anchors. A range alone in its bucket is finished.
    # Written, so that both sides of the join are plain and a hot anchor's rows can be split.
    shared = written(ranges.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    ranges = written(ranges.join(shared, "anchor", "left_semi"))
    # Buckets of whole ranges. One row per distinct content, however many share it.
    classes = written(ranges.groupBy("anchor", "f0", "f1").agg(F.count("*").alias("n"), F.min(here).alias("r")))
    many = classes.where("n > 1").select("anchor", "f0", "f1")
    found = _spans(ranges.join(many, ["anchor", "f0", "f1"], "left_semi"), length)
    # Only an anchor with several contents is refined; a repeated content takes part by one member.
    mixed = written(classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1"))
    members = classes.join(mixed, "anchor", "left_semi").select("r.*", "anchor", (F.col("n") == 1).alias("member"))
    for size in CELLS:
        listed = members.groupBy("_row").agg(F.collect_list(F.struct(*_PLACE)).alias("open"))
        cells = written(
            texts.join(listed, "_row")
            .select("_row", "_text", "open")
            .mapInArrow(_cells(length, size), place + ", member boolean, cell int, c0 bigint, c1 bigint, f0 bigint, f1 bigint")
        )
        key, core = ["anchor", "cell", "f0", "f1"], ["anchor", "cell", "c0", "c1"]
        one = F.struct("_row", "lo", "width", "back", "member")
        classes = cells.groupBy(*key, "c0", "c1").agg(F.count("*").alias("n"), F.min(one).alias("r"))
        if size > 1:
            classes = written(classes)
        many = classes.where("n > 1").select(*key)
        found = found.unionByName(_spans(cells.where("member").join(many, key, "left_semi"), length))
        if size > 1:
            single = (F.col("n") == 1) & F.col("r.member")
            mixed = classes.groupBy(*core).agg(F.count("*").alias("k"), F.max(single).alias("open")).where("k > 1 AND open")
            members = classes.join(mixed, core, "left_semi").select("r._row", "r.lo", "r.width", "r.back", "anchor", single.alias("member"))
    return found


def _by_row(docs: DataFrame, text_col: str) -> DataFrame:
    """Number the rows and lay them out by that number, so that later joins move no text."""
    spark = docs.sparkSession
    parts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"rows_{uuid.uuid4().hex}"
    (
        docs.withColumn("_text", text_of(text_col))
        .drop(text_col)
        .withColumn("_row", F.monotonically_increasing_id())
        .repartition(parts, "_row")
        .write.option("path", shared_folder(spark))
        .bucketBy(parts, "_row")
        .saveAsTable(name)
    )
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what was read knows their layout
    return table


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """Cut out every byte covered by a ``length``-byte string that also starts elsewhere.

    ``docs`` may have any columns; all but the text are kept, but for those named
    like a result (``n_bytes``, ``n_removed``, ``n_spans`` long and ``kept``
    binary, the remaining bytes joined). A null text counts as empty. A text
    shorter than ``length`` loses nothing. Rows are told apart by a number of
    their own: ids may be null or repeated, and equal rows are copies of each
    other that both lose what they share. An empty table gives an empty result.
    ``length`` is at least 100.
    """
    if length < 100:
        raise ValueError("length must be at least 100 bytes")
    bounded_batches(docs.sparkSession)
    texts = _by_row(without(docs, [*OUTPUT, "_row", "_text", "spans"]), text_col)
    spans = repeated_spans(texts, length).groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    joined = texts.join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", none)).drop("_row")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name not in ("_text", "_row")]
    return joined.mapInArrow(_remove, ", ".join([*fields, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"]))


def drop_repeats(docs: DataFrame, length: int = 240, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; all columns and rows stay.

    A character that a cut splits goes whole. A null text stays null; a text that
    is repeated from end to end becomes empty. ``chars_col``, where present, is set
    to the new number of characters.
    """
    marked = docs.withColumn("_null", F.col(text_col).isNull())
    rows = remove_repeats(marked, length, text_col)
    whole = F.regexp_replace(F.expr("make_valid_utf8(CAST(kept AS STRING))"), "\\x{FFFD}", "")
    cut = F.when(~F.col("_null"), F.when(F.col("n_removed") > 0, whole).otherwise(F.col("kept").cast("string")))
    out = rows.withColumn(text_col, cut)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(~F.col("_null"), F.length(text_col)).otherwise(0).cast(kind))
    return out.select(*docs.columns)
