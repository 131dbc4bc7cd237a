"""How text filters interact: what each removes in every order, and at what cost.

1. One pass over the texts gives every document a mask with a bit per filter that it
   fails, and a 64-bit hash of its text; only these narrow facts are written.
2. A counting Bloom filter over the hashes: a hash has ``HASHES`` cells in one shard of
   ``SHARD`` cells. Each task counts its cells (Spark's partial aggregation), and the
   counts of all tasks are added cell by cell. What stays of the merged sketch is one
   bit per cell: counted twice or more. A text with a cell that is not is unique for
   certain.
3. Only texts whose cells are all set, possible repeats, are shuffled. Grouping by the
   full text gives the smallest id of each exactly.
4. That id goes back to the facts by hash. Where two different repeated texts share a
   hash, these few rows are decided by their full text instead.
5. Flags and labels are counted per part and mask. Counts of disjoint masks add up, so
   all orders and steps follow from at most 2**filters counts per part; no document is
   visited again.

The sketch is broadcast while its size, known from the number of rows, is at most
``broadcast_bytes``; beyond it is joined by shard, in a join that Spark can split.
Copies of one text meet in partial aggregates first, so a text that a third of all rows
have costs one row per task.

Defined for awkward rows: a null text is the empty text; a null part is the empty
string; a null id fails no duplicate filter and makes no other row fail it; rows that
share both id and text do not make each other fail; a label table may name an id more
than once (any of its rows counts) or not at all; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import text_of, written

SHARD = 32768  # cells; one of Spark's bitmaps
CELLS_PER_ROW = 16
HASHES = 3
BROADCAST_BYTES = 64 << 20


def text_filters(text: str = "_text") -> dict[str, Column]:
    """The four filters on a text alone, by letter: true where the text fails."""
    words = F.array_remove(F.split(F.col(text), r"[ \t-\r]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }


def _cells(shards: int) -> list[Column]:
    """Shard and cells of the hash ``_h``."""
    cells = F.array(*[F.pmod(F.xxhash64(F.col("_h"), F.lit(k)), F.lit(SHARD)).cast("int") for k in range(HASHES)])
    return [F.pmod(F.col("_h"), F.lit(shards)).alias("_shard"), F.array_distinct(cells).alias("_cells")]


def repeated_cells(hashes: DataFrame, shards: int) -> DataFrame:
    """(_shard, _bits): the cells of the merged counting Bloom filter that were counted twice or more."""
    counted = hashes.select(*_cells(shards)).select("_shard", F.explode("_cells").alias("_cell")).groupBy("_shard", "_cell").count()
    return counted.where("count > 1").groupBy("_shard").agg(F.bitmap_construct_agg(F.col("_cell").cast("long")).alias("_bits"))


def possible_repeats(rows: DataFrame, hashes: DataFrame, n_rows: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows (with their hash ``_h``) whose text may occur twice; no repeat is ever left out."""
    shards = max(1, -(-n_rows * CELLS_PER_ROW // SHARD))
    sketch = written(repeated_cells(hashes, shards))
    if shards * (SHARD // 8 + 16) <= broadcast_bytes:
        sketch = F.broadcast(sketch)

    def is_set(cell: Column) -> Column:
        byte = F.substring("_bits", F.shiftright(cell, 3) + 1, F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), cell.bitwiseAND(F.lit(7))) == 1

    return rows.select("*", *_cells(shards)).join(sketch, "_shard").where(F.forall("_cells", is_set)).select(*rows.columns)


def _copies(rows: DataFrame, facts: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(_part, _id, _mask, _copy) per row: whether a smaller id has the same text."""
    suspects = possible_repeats(rows.select("_id", "_text", "_h"), facts.select("_h"), facts.count(), broadcast_bytes)
    texts = suspects.groupBy("_h", "_text").agg(F.min("_id").alias("_least"), F.count("*").alias("_rows"))
    firsts = texts.groupBy("_h").agg(F.min("_least").alias("_least"), F.sum("_rows").alias("_rows"), F.count("*").alias("_texts"))
    # Written, so that the join below has two plain sides and Spark can split a hot hash.
    firsts = written(firsts.where("_rows > 1"))
    copy = F.coalesce(F.col("_id") > F.col("_least"), F.lit(False)).alias("_copy")
    shared = firsts.where("_texts > 1").select("_h")
    if shared.isEmpty():
        return facts.join(firsts, "_h", "left").select("_part", "_id", "_mask", copy)
    # Different texts under one hash: these rows are read once more and decided by full text.
    unclear = written(rows.join(shared, "_h", "left_semi"))
    least = written(unclear.groupBy("_text").agg(F.min("_id").alias("_least")))
    clear = facts.join(shared, "_h", "left_anti").join(firsts, "_h", "left").select("_part", "_id", "_mask", copy)
    return clear.union(unclear.join(least, "_text").select("_part", "_id", "_mask", copy))


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column] | None = None,
    copy_filter: str = "E",
    part_col: str = "lang",
    broadcast_bytes: int = BROADCAST_BYTES,
    text_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters.

    Bit k of ``mask`` is the k-th filter; the last one is ``copy_filter``. ``filters``
    are conditions on a column ``_text``.
    """
    filters = filters or text_filters()
    bits = [F.when(condition, 1 << k).otherwise(0) for k, condition in enumerate(filters.values())]
    text = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.col("doc_id").alias("_id"), text_of("text").alias("_text"))
    rows = text.select("*", text_hash(F.col("_text")).cast("long").alias("_h"), reduce(Column.__add__, bits).alias("_mask"))
    facts = written(rows.select("_part", "_id", "_h", "_mask"))
    marks = written(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("_toxic")))
    failing = _copies(rows, facts, broadcast_bytes).join(marks, "_id", "left")
    mask = F.col("_mask") + F.when(F.col("_copy"), 1 << len(filters)).otherwise(0)
    return failing.groupBy(F.col("_part").alias("part"), mask.alias("mask")).agg(F.count("*").alias("n"), F.count("_good").alias("good"), F.count("_toxic").alias("toxic"))


def orders_of(counts: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters, step by step, from the counts of ``mask_counts``.

    kept: documents after this step; removed: by it; redundant: failing its filter, but
    removed earlier; unique_fails: failing no other filter; good_lost, toxic_lost:
    removed here with that label; shapley: what its filter removes over all orders.
    """
    n = len(letters)
    masks = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # 2**n at most
    parts = counts.groupBy("part").agg(masks.alias("_masks"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.select("part", "_masks", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = {letter: F.instr("filter_order", letter) for letter in letters}
    own = reduce(Column.__add__, [F.when(place[x] == F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(letters)])
    before = reduce(Column.__add__, [F.when(place[x] < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(letters)])
    steps = steps.withColumns({"_own": own, "_before": before})

    def total(field: str, condition: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.filter("_masks", lambda m: condition(m["mask"])), F.lit(0).cast("long"), lambda s, m: s + m[field] * weight(m["mask"]))

    fails = lambda mask: mask.bitwiseAND(F.col("_own")) != 0
    gone = lambda mask: mask.bitwiseAND(F.col("_before")) != 0
    # In one n-th of all orders each failed filter comes first among those a document fails.
    share = lambda mask: F.floor(F.lit(factorial(n)) / F.bit_count(mask))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~gone(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("_own")).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copy_filter: str = "E", part_col: str = "lang", **options) -> DataFrame:
    """One row per part, order of the filters and step; see ``orders_of``."""
    filters = filters or text_filters()
    return orders_of(mask_counts(docs, labels, filters, copy_filter, part_col, **options), "".join(filters) + copy_filter)
