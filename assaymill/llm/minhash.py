"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard.

One permutation scatters the shingles, a second one gives the hash values; every
coordinate of the signature uses that second permutation shifted by one more
place around the circle of 32-bit numbers, so two permutations make all of them.
Rows of coordinates become bands; documents that share a band meet in a bucket.

* Documents with one shingle set are collapsed to one node before anything is
  compared, so exact copies never form pairs.
* Buckets with the same members, which near copies make by the dozen, are
  compared once.
* A bucket of any size is cut into blocks, and every two blocks meet in a task
  of their own with the full shingle sets. The task compares them by matrix
  products and returns a spanning forest of its links: at most one row per
  member, whatever the number of links, and no pair is left out.
* Components come from alternating large-star and small-star rounds.

A pair at the threshold itself escapes all bands with a chance of less than one
in a million: 7e-7 at 0.85 with 24 bands of 5, and 2e-7 at 0.8 with 30 bands of 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import BASE, U64, bounded_batches, mix, pieces, signed, text_of, without, words_of, written

WIDTH = 5
BLOCK = 256
OUTPUT = ("n_shingles", "component_id", "kept")
_SET_SALT = U64(0x5851F42D4C957F2D)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a similarity of at least ``percent`` in a hundred."""
    rows = max(2, min(5, percent // 17))
    bands, miss = 1, 1.0
    while (miss := (1 - (percent / 100) ** rows) ** bands) > 8e-7:
        bands += 1
    return bands, rows


def shingle_sets(words: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a shorter row has its whole sequence as one."""
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), U64)
    for k in range(width if n > 0 else 0):
        rolled = rolled * BASE + words[k : k + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            value = np.array([b - a], U64)
            for k in range(a, b):
                value = mix(value * BASE + words[k : k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, U64))
    return out


def _permute(x: np.ndarray) -> np.ndarray:
    """The circulated permutation: a bijection on 32 bits."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash coordinates of non-empty sets, one row per set."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    # The initial permutation: the shingle's place on the circle.
    place = (mix(np.concatenate(sets) ^ _SET_SALT) >> U64(32)).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_permute(place + np.uint32(k)), starts)
    return out


def _sketch(bands: int, rows: int):
    """Map batches (_node, _text) to set size, set digest and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column("_text")):
                sets = shingle_sets(*words_of(data, offsets))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                digest = np.zeros((len(sets), 2), U64)
                keys: list = [None] * len(sets)
                if len(full):
                    chosen = [sets[k] for k in full]
                    at = np.cumsum([0, *sizes[full][:-1]])
                    every = np.concatenate(chosen)
                    digest[full, 0] = np.add.reduceat(mix(every ^ BASE), at)
                    digest[full, 1] = np.add.reduceat(mix(every + BASE), at)
                    values = signatures(chosen, bands * rows).astype(U64).reshape(len(full), bands, rows)
                    key = np.broadcast_to(np.arange(bands, dtype=U64), (len(full), bands)).copy()
                    for r in range(rows):
                        key = mix(key * BASE + values[:, :, r])
                    for k, row in zip(full, signed(key)):
                        keys[k] = row
                cut = [batch.column(c).slice(first, last - first) for c in ("_id", "_node")]
                yield pa.RecordBatch.from_arrays(
                    [*cut, pa.array(sizes), pa.array(signed(digest[:, 0])), pa.array(signed(digest[:, 1])), pa.array(keys, pa.list_(pa.int64()))],
                    names=["_id", "_node", "n", "s0", "s1", "bands"],
                )

    return run


class _Repeats:
    """Whether a set was seen before among the rows of its node that stand together."""

    def __init__(self) -> None:
        self.node, self.seen = None, set()

    def __call__(self, node: int, content: bytes) -> bool:
        if node != self.node:
            self.node, self.seen = node, set()
        if content in self.seen:
            return True
        self.seen.add(content)
        return False


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map batches (_node, _text, seats) to one row per seat, with the node's shingle set.

    Rows that repeat a node and its set, next to each other, are one.
    """
    repeated = _Repeats()
    for batch in batches:
        nodes_of = batch.column("_node").to_numpy()
        for first, last, data, offsets in pieces(batch.column("_text")):
            sets = shingle_sets(*words_of(data, offsets))
            seats = batch.column("seats").slice(first, last - first)
            once = np.array([not repeated(nodes_of[first + k], s.tobytes()) for k, s in enumerate(sets)], bool)
            if not once.all():
                seats = pa.compute.if_else(pa.array(once), seats, pa.scalar([], seats.type))
            counts = pa.compute.list_value_length(seats).to_numpy()
            inner = seats.flatten()
            row = np.repeat(np.arange(last - first), counts)
            step = max(1, (4 << 20) // max(1, 8 * max(map(len, sets))))
            for k in range(0, len(row), step):
                part = inner.slice(k, step)
                own = row[k : k + step]
                values = pa.array([sets[r].tobytes() for r in own], pa.binary())
                nodes = batch.column("_node").take(pa.array(own + first))
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in ("b", "i", "j", "own")), nodes, values], names=["b", "i", "j", "own", "_node", "set"])


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets have intersection * 100 >= percent * union, as a boolean matrix."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        common = np.array([[0, n := len(np.intersect1d(*sets, assume_unique=True))], [n, 0]])
    else:
        values, which = np.concatenate(sets), np.repeat(np.arange(m), sizes)
        order = np.argsort(values, kind="stable")
        values, which = values[order], which[order]
        new = np.concatenate(([True], values[1:] != values[:-1]))
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] > 1
        which, group = which[often], np.unique(group[often], return_inverse=True)[1]
        common = np.zeros((m, m), np.float64)
        for k in range(0, int(group[-1]) + 1 if len(group) else 0, 4096):
            a, b = np.searchsorted(group, (k, k + 4096))
            present = np.zeros((m, min(4096, int(group[-1]) + 1 - k)), np.float32)
            present[which[a:b], group[a:b] - k] = 1
            common += present @ present.T
        common = np.rint(common).astype(np.int64)
    return common * 100 >= percent * (sizes[:, None] + sizes[None, :] - common)


def _forest(percent: int):
    """Map rows sorted by (b, i, j) to the edges of a spanning forest of each group's links."""

    def edges(nodes: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        order = np.argsort(nodes, kind="stable")
        nodes, sets = nodes[order], [sets[k] for k in order]
        linked = _links(sets, percent)
        label = np.arange(len(nodes))
        while True:  # the smallest label in reach, until nothing changes
            new = np.minimum(label, np.where(linked, label[None, :], len(nodes)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        for k in np.flatnonzero(label != np.arange(len(nodes))):
            yield int(nodes[k]), int(nodes[label[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, out, repeated = None, [], [], [], _Repeats()

        def flush() -> None:
            if len(nodes) > 1:
                out.extend(edges(np.array(nodes), sets))

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("b", "i", "j")])
            ids = batch.column("_node").to_numpy()
            values = batch.column("set")
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if key != (now := tuple(keys[a])):
                    flush()
                    key, nodes, sets, repeated = now, [], [], _Repeats()
                for node, value in zip(ids[a:b], values.slice(a, b - a)):
                    # Rows that repeat an id and its text would widen the matrix for nothing.
                    if not repeated(node, value.as_py()):
                        nodes.append(node)
                        sets.append(np.frombuffer(value.as_buffer(), U64))
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                out.clear()
        flush()
        if out:
            pairs = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, label): the smallest node that each can reach.

    Alternates large-star and small-star, each a minimum per node joined back,
    until the edges no longer change; every round is written to the shared folder.
    """

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        if both:
            pairs = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join has two plain sides and a hub's edges can be split.
        least = written(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        joined = pairs.join(least, "a")
        if both:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = state(now)
    while True:
        large = star(now, True).where("a > b").distinct()
        now = written(star(large, False).where("a > b").distinct())
        if (after := state(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = after


def _node(id_col: str, text_col: str) -> Column:
    """A row's key: its id, or for a null id a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("null id"), text_of(text_col)))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group near-duplicate documents: (id, n_shingles, component_id, kept) per row.

    A-Z become lower case; words are runs of anything but ASCII white space; a
    document's set holds its distinct 5-word shingles, or the whole sequence where
    it has fewer words. Two documents are linked where 100 * intersection >=
    ``percent`` * union of their full sets. ``component_id`` is the smallest id
    that links reach; ``kept`` marks the row with that id.

    Null or empty texts, and texts without words, have an empty set and are linked
    with nothing. Rows with a null id take part by their text: their component is
    named by the smallest id in it, or null if it has none, and they are kept only
    in the latter case. Rows that repeat an id and its text are copies and share
    ``kept``. Ids are integers. An empty table gives an empty result. Columns other
    than id and text are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = banding(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), _node(id_col, text_col).alias("_node"), text_of(text_col).alias("_text"))
    sketches = written(texts.mapInArrow(_sketch(bands, rows), "_id bigint, _node bigint, n bigint, s0 bigint, s1 bigint, bands array<bigint>"))
    # One node for each distinct set: the smallest key; its bands are those of all its members.
    classes = written(sketches.where("n > 0").groupBy("s0", "s1").agg(F.min("_node").alias("rep"), F.min("_id").alias("least"), F.any_value("bands").alias("bands")))
    seats = classes.select("rep", F.explode("bands").alias("b"))
    sizes = seats.groupBy("b").agg(
        F.count("*").alias("size"), F.expr("bit_xor(xxhash64(rep))").alias("d0"), F.expr("bit_xor(xxhash64(rep, 1))").alias("d1")
    )
    # Buckets with the same members are one.
    buckets = sizes.where("size > 1").groupBy("size", "d0", "d1").agg(F.min("b").alias("b")).select("b", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    seats = seats.join(buckets, "b").withColumn("own", F.pmod(F.hash("rep"), "blocks"))
    # Every two blocks of a bucket meet once; a bucket of one block meets itself.
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("b").alias("b"), F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), F.col("own").alias("own")))
    per_node = seats.select("rep", F.explode(met).alias("seat")).groupBy("rep").agg(F.collect_list("seat").alias("seats"))
    with_text = texts.join(per_node, texts["_node"] == per_node["rep"]).select("_node", "_text", "seats")
    met_rows = with_text.mapInArrow(_with_sets, "b bigint, i int, j int, own int, _node bigint, set binary")
    edges = met_rows.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "_node").mapInArrow(_forest(percent), "a bigint, b bigint")
    labels = components(edges)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("s0", "s1", F.coalesce("label", "rep").alias("label"), "least")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("label").alias("_first"))
    found = named.join(least, "label").select("s0", "s1", "component_id", "_first")
    joined = sketches.join(found, ["s0", "s1"], "left")
    lone = F.col("n") == 0
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(lone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
        (lone | F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("_node") == F.col("_first")))).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near duplicates of another row; all columns stay.

    Rows with a null id have nothing to be told apart by and stay.
    """
    dropped = near_duplicates(docs, percent, id_col, text_col).where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped["_gone"], "left_anti")
