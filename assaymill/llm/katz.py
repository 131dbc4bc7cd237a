"""Katz backoff language model: Good-Turing counts, exactly normalised, on Spark.

A token's probability after its predecessor is its discounted relative count where
the pair was seen in training, and the backoff weight of the predecessor times the
token's own probability otherwise:

    p(w | h) = d(c(h w)) c(h w) / c(h)      if the pair was seen
             = alpha(h) p(w)                 if not, and h was seen
             = p(w)                          if h was never seen
    alpha(h) = (1 - sum of the seen p(w | h)) / (1 - sum of p(w) over the same w)

p(w) is discounted the same way; what it leaves belongs to the unknown word, so both
levels add up to one. Counts up to ``TOP`` take Good-Turing discounts; larger ones
give up one in a hundred, so that every history keeps some mass for backing off.

How it runs:

1. Word counts become a table; N, V, the counts of counts and the words above one
   in ``HEAVY`` tokens come from it.
2. Pieces of text send their (word, predecessor, document) triples to buckets by
   the word, packed in arrays: each word and predecessor once per piece and bucket.
   The few heavy words are dealt by word and predecessor, so no bucket is hot.
3. A bucket knows every count of its words and pairs. It returns sums per document
   and per history, and the (history, document) places where a held-out text backs
   off; Spark adds these up.
4. Those places meet the table of backoff weights, and everything is summed per
   document.

A text's score is a sum of logarithms, so its parts may come from any bucket:
log c(h w) and log p(w) from the word's bucket, -log c(h) from the bucket where h
is the word, and discounts by counting how often each was used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import PIECE, U64, bounded_batches, gathered, hash_of_text, mix, pieces, signed, text_of, words_of, written

TOP = 5
LARGE = 0.99  # discount of counts above TOP
HEAVY = 2000
BUCKET_TOKENS = 3_000_000
PAIR_TOKENS = 500_000  # of a bucket that are counted at once
PIECE_BYTES = 8 << 20
START, END = U64(hash_of_text(" start ")), U64(hash_of_text(" end "))  # no word holds a space
OUTPUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_DOC, _HISTORY, _BACKOFF, _ROW = 0, 1, 2, 3
_SUMS = ["n", "known", "a", "b", *(f"m{r}" for r in range(1, TOP + 2)), "large"]


def discounts(count_of_counts: list[int]) -> np.ndarray:
    """Good-Turing discount of counts 0 (unused), 1 .. TOP, and of larger ones.

    ``count_of_counts[r]`` is how many things were seen r times, for r up to TOP + 1.
    Where the counts are too thin for a discount between 0 and 1, it is (r - 0.5) / r.
    """
    n = [float(x) for x in count_of_counts]
    out = np.full(TOP + 2, LARGE)
    shared = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - shared) / (1 - shared) if n[r] and shared < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Unigrams:
    total: int
    distinct: int
    discount: np.ndarray
    unknown: float  # probability of the unknown word
    heavy: np.ndarray  # sorted hashes of frequent words
    heavy_counts: np.ndarray

    def probability(self, count: np.ndarray) -> np.ndarray:
        known = self.discount[np.minimum(count, TOP + 1)] * count / max(1, self.total)
        return np.where(count > 0, known, self.unknown)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words_of`` a large piece, ``PIECE`` bytes of whole rows at a time: hashing takes many times the bytes it reads."""
    words, at, first, n = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0, 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        part, where = words_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        words.append(part)
        at.append(where[1:] + n)
        first, n = last, n + len(part)
    return np.concatenate(words), np.concatenate(at)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, predecessor, row) of every token of a piece; each row ends with one END."""
    words, at = _words(data, offsets)
    rows = len(offsets) - 1
    own = np.repeat(np.arange(rows), np.diff(at) + 1)
    ends = at[1:] + np.arange(rows)
    out = np.empty(len(words) + rows, U64)
    out[ends] = END
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1] + np.arange(rows)] = START
    return out, before, own


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (_train, _text) to (w, c): training words of each piece; one row with w null counts all tokens."""
    for batch in gathered(batches, PIECE_BYTES):
        train = batch.column("_train").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in pieces(batch.column("_text"), PIECE_BYTES):
            word, _, row = _tokens(data, offsets)
            w, c = np.unique(word[train[first:last][row]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*signed(w), 0], pa.int64(), mask=np.arange(len(w) + 1) == len(w)), pa.array([*c, len(word)], pa.int64())], names=["w", "c"])


def _squeezed(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte of their places, compressed; the width and the size stand first."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return bytes([x.itemsize]) + planes.size.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _spread(packed: bytes) -> np.ndarray:
    """What ``_squeezed`` was given."""
    planes = np.frombuffer(pa.decompress(pa.py_buffer(packed)[9:], int.from_bytes(packed[1:9], "little"), "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(packed[0], -1).T).view(f"u{packed[0]}").ravel()


def _packed(heavy: np.ndarray, buckets: int):
    """Map (_row, _id, _train, _text) to one row of packed triples per piece and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, PIECE_BYTES):
            train = batch.column("_train").to_numpy(zero_copy_only=False)
            rows = batch.column("_row").to_numpy()
            for first, last, data, offsets in pieces(batch.column("_text"), PIECE_BYTES):
                word, before, row = _tokens(data, offsets)
                k = np.minimum(np.searchsorted(heavy, word), len(heavy) - 1) if len(heavy) else None
                often = heavy[k] == word if len(heavy) else np.zeros(len(word), bool)
                bucket = (mix(np.where(often, word ^ mix(before), word)) % U64(buckets)).astype(np.int64)
                own = (row.astype(np.uint32) << np.uint32(1)) | train[first:last][row]
                out = []
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    at = order[edges[b] : edges[b + 1]]
                    w, iw = np.unique(word[at], return_inverse=True)
                    h, ih = np.unique(before[at], return_inverse=True)
                    by_word = np.argsort(iw, kind="stable")
                    short = np.uint16 if max(len(h), len(w)) <= 1 << 16 else np.uint32
                    docs = np.uint16 if last - first <= 1 << 15 else np.uint32
                    # Hashes are sorted, so their differences have leading zeros.
                    out.append((int(b), _squeezed(np.diff(w, prepend=U64(0))), _squeezed(np.bincount(iw).astype(np.uint32)), _squeezed(np.diff(h, prepend=U64(0))), _squeezed(ih[by_word].astype(short)), _squeezed(own[at][by_word].astype(docs))))
                names = ["bucket", "w", "n", "h", "ih", "docs"]
                columns = [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[c] for x in out], pa.binary()) for c in range(1, 6))]
                known = rows[first:last].astype(np.int64).tobytes()
                # Numbers that run on are known by the first.
                short = known[:8] if rows[last - 1] - rows[first] == last - first - 1 else known
                yield pa.RecordBatch.from_arrays([*columns, pa.array([short] * len(out), pa.binary())], names=[*names, "rows"])
                # The rows themselves travel along, so that their numbers are drawn only once.
                flags = train[first:last] | (batch.column("_id").slice(first, last - first).is_null().to_numpy(zero_copy_only=False) << 1)
                own_ids = batch.column("_id").slice(first, last - first).fill_null(0).to_numpy().tobytes()
                one = [own_ids, b"", b"", b"", flags.astype(np.uint8).tobytes(), known]
                yield pa.RecordBatch.from_arrays([pa.array([int(rows[first]) % buckets], pa.int32()), *(pa.array([x], pa.binary()) for x in one)], names=[*names, "rows"])

    return run


def _sums(unigrams: Unigrams):
    """Map packed rows, sorted by bucket, to partial sums (kind, k1, k2, ...)."""

    def rows_of(kind: int, k1: np.ndarray, k2: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
        n = len(k1)
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(k1.astype(np.int64, copy=False)), pa.array(k2.astype(np.int64, copy=False))]
        for name in _SUMS:
            kind_ = np.float64 if name in "ab" else np.int64
            columns.append(pa.array(values.get(name, np.zeros(n, kind_)).astype(kind_)))
        return pa.RecordBatch.from_arrays(columns, names=["kind", "k1", "k2", *_SUMS])

    def bucket(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], []
        for x in blocks:
            if x["n"]:
                held.append(x)
                rows_held.append(np.frombuffer(x["rows"], np.int64))
                continue
            flags = np.frombuffer(x["docs"], np.uint8)
            yield rows_of(_ROW, np.frombuffer(x["rows"], np.int64), np.frombuffer(x["w"], np.int64), n=flags & 1, known=flags >> 1)
        blocks.clear()
        if not held:
            return
        # Each block lists its words and histories once, so tokens become small numbers without sorting their hashes.
        lists = [(np.cumsum(_spread(x["w"]), dtype=U64), np.cumsum(_spread(x["h"]), dtype=U64), _spread(x["n"])) for x in held]
        words, histories = (np.unique(np.concatenate([x[k] for x in lists])) for k in (0, 1))
        n_tokens = sum(int(x[2].sum()) for x in lists)
        iw, ih, idoc, train = np.empty(n_tokens, np.int32), np.empty(n_tokens, np.int32), np.empty(n_tokens, np.int32), np.empty(n_tokens, bool)
        docs, first, n_docs = [], 0, 0
        for k, rows in enumerate(rows_held):
            (w, h, n), x = lists[k], held[k]
            held[k] = lists[k] = None
            own = _spread(x["docs"])
            at = slice(first, first + len(own))
            iw[at] = np.repeat(np.searchsorted(words, w).astype(np.int32), n)
            ih[at] = np.searchsorted(histories, h).astype(np.int32)[_spread(x["ih"])]
            train[at] = own & 1
            # Every row of the table is in one piece, so no other block of the bucket has these.
            here, inverse = np.unique(own >> 1, return_inverse=True)
            idoc[at] = inverse + n_docs
            docs.append(rows[here] if len(rows) > 1 else rows[0] + here.astype(np.int64))
            first, n_docs = at.stop, n_docs + len(here)
        docs = np.concatenate(docs)
        count = np.bincount(iw[train], minlength=len(words))
        if len(unigrams.heavy):  # their counts are known, only a share of them is here
            k = np.minimum(np.searchsorted(unigrams.heavy, words), len(unigrams.heavy) - 1)
            count = np.where(unigrams.heavy[k] == words, unigrams.heavy_counts[k], count)
        # Pairs and their histories, a share of the tokens at a time; the pairs of one word are together.
        size = len(histories)
        sums = {name: np.zeros(size, float if name == "a" else np.int64) for name in ("n", "a", *(f"m{r}" for r in range(1, TOP + 2)), "large")}
        seen_pairs = np.empty(n_tokens, np.int32)
        shares = max(1, -(-n_tokens // PAIR_TOKENS))
        for share in range(shares):
            own = np.flatnonzero(iw % shares == share) if shares > 1 else np.arange(n_tokens)
            pairs, ip = np.unique(iw[own].astype(np.int64) * size + ih[own], return_inverse=True)
            pair_count = np.bincount(ip[train[own]], minlength=len(pairs))
            seen_pairs[own] = pair_count[ip]
            seen = np.flatnonzero(pair_count)
            of, c = pairs[seen] % size, pair_count[seen]
            for r in range(1, TOP + 2):
                sums[f"m{r}"] += np.bincount(of[c == r], minlength=size)
            sums["large"] += np.bincount(of[c > TOP], minlength=size)
            sums["n"] += np.bincount(of, c, minlength=size).astype(np.int64)
            sums["a"] += np.bincount(of, unigrams.probability(count[pairs[seen] // size]), minlength=size)
        any_ = np.flatnonzero(sums["n"])
        yield rows_of(_HISTORY, histories[any_].view(np.int64), np.zeros(len(any_)), **{k: v[any_] for k, v in sums.items()})
        # Documents.
        size = len(docs)
        values = {name: np.zeros(size, float if name in "ab" else np.int64) for name in _SUMS if name != f"m{TOP + 1}"}
        for first in range(0, n_tokens, PAIR_TOKENS):
            at = slice(first, first + PAIR_TOKENS)
            of, c, own = idoc[at], seen_pairs[at], count[iw[at]]
            hit = c > 0
            part = np.zeros(len(c))
            part[hit] = np.log10(c[hit])
            part[~hit] = np.log10(unigrams.probability(own[~hit]))
            history = (own > 0) & (words[iw[at]] != END)
            part[history] -= np.log10(own[history])
            for r in range(1, TOP + 1):
                values[f"m{r}"] += np.bincount(of[c == r], minlength=size)
            values["large"] += np.bincount(of[c > TOP], minlength=size)
            values["n"] += np.bincount(of, minlength=size)
            values["known"] += np.bincount(of[own > 0], minlength=size)
            values["a"] += np.bincount(of, np.log10(own + 0.5), minlength=size)
            values["b"] += np.bincount(of, part, minlength=size)
        yield rows_of(_DOC, docs, np.zeros(size), **values)
        # Places where a text backs off.
        miss = np.flatnonzero(seen_pairs == 0)
        place, n = np.unique(ih[miss].astype(np.int64) * len(docs) + idoc[miss], return_counts=True)
        yield rows_of(_BACKOFF, histories[place // len(docs)].view(np.int64), docs[place % len(docs)], n=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if blocks and x["bucket"] != now:
                    yield from bucket(blocks)
                    blocks = []
                now = x["bucket"]
                blocks.append(x)
        if blocks:
            yield from bucket(blocks)

    return run


def count_words(texts: DataFrame) -> tuple[Unigrams, int, DataFrame]:
    """Scalars of the word counts, the number of all tokens, and the (w, c) table."""
    table = written(texts.select("_train", "_text").mapInArrow(_word_counts, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")))
    every = table.where("w IS NULL").first()
    words = table.where("w IS NOT NULL")
    few = {r["r"]: r for r in words.groupBy(F.least("c", F.lit(TOP + 2)).alias("r")).agg(F.count("*").alias("k"), F.sum("c").alias("n")).collect()}
    total, distinct = sum(r["n"] for r in few.values()), sum(r["k"] for r in few.values())
    discount = discounts([few[r]["k"] if r in few else 0 for r in range(TOP + 2)])
    left = sum((1 - discount[min(r, TOP + 1)]) * x["n"] for r, x in few.items()) / total if total else 1.0
    # At most HEAVY words can be that frequent.
    top = words.where(F.col("c") > total / HEAVY).orderBy("w").collect()
    heavy = np.array([r["w"] for r in top], np.int64).view(U64)
    order = np.argsort(heavy)
    counts = np.array([r["c"] for r in top], np.int64)
    return Unigrams(total, distinct, discount, left, heavy[order], counts[order]), (every["c"] if every else 0), words


def score_texts(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where ``train_col`` holds and score every row.

    Returns id, ``train_col``, n_tokens, n_known, train_tokens, base_score (add-half
    unigrams) and score (Katz backoff), both log10 probabilities of the whole text.
    A-Z become lower case; tokens are runs of anything but ASCII white space, then
    one end. Null texts count as empty: one token, the end. A null ``train_col``
    is false. Without training rows every probability is the unknown word's.
    Ids are integers; null ids and repeated rows are rows like any other. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(train_col), F.lit(False)).alias("_train"), text_of(text_col).alias("_text")
    )
    unigrams, tokens, _ = count_words(texts)
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    shape = "bucket int, w binary, n binary, h binary, ih binary, docs binary, rows binary"
    packed = texts.mapInArrow(_packed(unigrams.heavy, buckets), shape)
    partial = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _sums(unigrams), "kind int, k1 bigint, k2 bigint, " + ", ".join(f"{c} {'double' if c in 'ab' else 'bigint'}" for c in _SUMS)
    )
    sums = written(partial.groupBy("kind", "k1", "k2").agg(*[F.sum(c).alias(c) for c in _SUMS]))
    ids = sums.where(F.col("kind") == _ROW).select(
        F.col("k1").alias("_row"), F.when(F.col("known") == 0, F.col("k2")).alias("_id"), (F.col("n") == 1).alias("_train")
    )
    histories = sums.where(F.col("kind") == _HISTORY)
    counted = histories.agg(*[F.coalesce(F.sum(f"m{r}"), F.lit(0)).alias(f"m{r}") for r in range(1, TOP + 2)]).first()
    discount = discounts([0, *counted])
    starts = histories.where(F.col("k1") == int(signed(np.array([START]))[0])).select("n").first()
    taken = sum((F.col(f"m{r}") * float(r * (1 - discount[r])) for r in range(1, TOP + 1)), F.lit(0.0))
    # Counts above TOP: what is left of c(h) after the small ones.
    large = F.col("n") - sum((F.col(f"m{r}") * r for r in range(1, TOP + 1)), F.lit(0))
    mass = (taken + large * (1 - LARGE)) / F.col("n")
    weights = histories.select(F.col("k1").alias("h"), (F.log10(mass / (1 - F.col("a"))) + F.log10(F.col("n").cast("double"))).alias("back"))
    places = sums.where(F.col("kind") == _BACKOFF).select(F.col("k1").alias("h"), F.col("k2").alias("_row"), "n")
    backed = places.join(weights, "h").groupBy("_row").agg(F.sum(F.col("n") * F.col("back")).alias("back"))
    used = sum((F.col(f"m{r}") * float(np.log10(discount[r])) for r in range(1, TOP + 1)), F.col("large") * float(np.log10(LARGE)))
    start = float(np.log10(starts["n"])) if starts else 0.0
    base = float(np.log10(unigrams.total + 0.5 * (unigrams.distinct + 1)))
    own = sums.where(F.col("kind") == _DOC).select(F.col("k1").alias("_row"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), (F.col("a") - F.col("n") * base).alias("base_score"), (F.col("b") + used - start).alias("_b"))
    joined = ids.join(own, "_row").join(backed, "_row", "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_train").alias(train_col),
        "n_tokens",
        "n_known",
        F.lit(unigrams.total).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("_b") + F.coalesce("back", F.lit(0.0))).alias("score"),
    )
