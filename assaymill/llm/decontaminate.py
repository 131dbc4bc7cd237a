"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

1. Every benchmark item gets two 64-bit SimHashes of its word shingles: one with
   equal votes, one with weighted votes.
2. Every document is cut into windows of an item's number of words, at every
   start. A window similar to an item of its size holds a certain number (or
   weight) of shingles of such items; running sums over the places of shared
   shingles tell the starts where it does, and only those are hashed.
3. Fingerprints meet by multi-index blocks: 8 blocks of 8 bits. Within a radius of
   23 some block differs in at most 2 bits, so the items are listed under all 37
   such values of each block, and no fingerprint within the radius is missed.
   Weighted fingerprints of items with unequal weights have a radius of 31 and all
   93 values within 3 bits.
4. Candidates are verified by the exact Jaccard similarity of their shingles, with
   equal weights and with these: a shingle weighs one over the number of distinct
   items (by their words) that hold it; shingles of no item weigh 1. The larger of
   the two counts, so a pair that reaches the limit either way is kept.

With equal votes the expected distance is 10 bits at a similarity of 0.8, with a
deviation of 3, so the radius leaves out about one pair in a hundred thousand at
the threshold and none to speak of above it. A pair that is at 0.8 by weights but
below it without them has a cosine of 0.8 at least where the window's other shingles
are of no item: 13 bits are expected with a deviation of 3.2, well within 31. Where
they are of other items with very unequal weights the cosine can be lower, and such
a pair may be missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill.llm.common import text_of, written

WIDTH = 5
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
# For weighted votes of items whose shingles weigh unequally.
WIDE_BLOCK_RADIUS = BLOCK_RADIUS + 1
WIDE_RADIUS = BLOCKS * (WIDE_BLOCK_RADIUS + 1) - 1
# Texts with a window to try, at 8 bytes each, up to which their list is broadcast.
BROADCAST_IDS = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """Hashes of the words: A-Z as lower case, parted by ASCII white space."""
    words = F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order; empty where there are fewer."""
    at = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def _width(size: Column) -> Column:
    return F.least(size, F.lit(WIDTH))


def _any_width(words: Column, size: Column, widths: list[int]) -> Column:
    """Shingles of five words, or of ``size`` words where an item is shorter."""
    return reduce(lambda rest, w: F.when(_width(size) == w, shingles(words, w)).otherwise(rest), widths, F.array().cast("array<bigint>"))


def simhash(weighted: Column) -> Column:
    """64 bits, each the sign of the weighted vote of the (h, w) entries."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.when(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + F.when(F.getbit(x["h"], b) == 1, x["w"]).otherwise(-x["w"])) > 0, F.lit(1)).otherwise(F.lit(0)),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _seat(size: Column, weighted: Column, block: Column | int, value: Column) -> Column:
    return ((size.cast("long") * 2 + weighted.cast("int")) * BLOCKS + block) * (1 << BLOCK_BITS) + value


def _near(radius: int) -> Column:
    return F.array(*[F.lit(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= radius])


def _equal(weighted: Column) -> Column:
    """The same shingles with a weight of 1 each."""
    return F.transform(weighted, lambda x: F.struct(x["h"].alias("h"), F.lit(1.0).alias("w")))


def _even(weighted: Column) -> Column:
    return F.forall(weighted, lambda x: x["w"] == 1)


def _total(weighted: Column) -> Column:
    return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x["w"])


def _items(ids: DataFrame, widths: list[int]) -> DataFrame:
    """(seq, size, weighted shingles) per distinct sequence of words."""
    sized = ids.select("seq", "words").dropDuplicates(["seq"]).withColumn("size", F.size("words"))
    each = sized.select("seq", "size", F.explode(F.array_distinct(_any_width(F.col("words"), F.col("size"), widths))).alias("h"))
    rarity = each.groupBy("h").agg((1.0 / F.count("*")).alias("w"))
    return each.join(rarity, "h").groupBy("seq", "size").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("weighted"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Best match of every document and item: (id, item_id, first_word, n_words, distance, similarity).

    ``first_word`` counts words from 0, ``distance`` is the Hamming distance of the
    fingerprints that met. Of windows that tie, those that line a shared shingle up
    with its place in an item win, then the first. Items under five words are
    one shingle. Null or empty texts and items match nothing. Null ids are
    matched like any other value; rows that repeat an id give one row per item.
    Columns beyond ids and texts are ignored.
    """
    lengths = benchmark.select(_width(F.size(word_hashes(text_of(item_text)))).alias("n")).where("n > 0").distinct()
    widths = sorted(r["n"] for r in lengths.collect()) or [WIDTH]  # five values at most
    words = benchmark.select(F.col(item_id).alias("_item"), word_hashes(text_of(item_text)).alias("words")).where(F.size("words") > 0).distinct()
    ids = written(words.withColumn("seq", F.xxhash64("words")))
    items = written(_items(ids, widths))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("_h"), text_of(text_col).alias("_text"))

    # What the similarity asks of a window: shingles of items of its size, by number or by weight.
    needs = items.groupBy("size").agg((similarity * F.min(F.size("weighted")) - 1e-6).alias("least_n"), (similarity * F.min(_total(F.col("weighted"))) - 1e-6).alias("least_w"))
    placed = ids.dropDuplicates(["seq"]).withColumn("size", F.size("words")).select("size", F.posexplode(_any_width(F.col("words"), F.col("size"), widths)).alias("back", "h"))
    places = items.select("size", F.explode("weighted").alias("x")).select("size", "x.h", "x.w").distinct().join(needs, "size")
    places = written(places.join(placed.groupBy("size", "h").agg(F.collect_set("back").alias("backs")), ["size", "h"]))
    own = texts.withColumn("_words", word_hashes(F.col("_text")))
    # An outer explode: the plain one would test the array's size first and build it twice.
    found = []
    for width in widths:
        at = own.select("_h", F.size("_words").alias("n"), F.posexplode_outer(shingles(F.col("_words"), width)).alias("pos", "h"))
        found.append(at.join(places.where(_width(F.col("size")) == width), "h"))
    hits = written(reduce(DataFrame.unionByName, found))
    # A shingle enters at the first start whose window holds it, and leaves after the last.
    latest = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    first = F.greatest(F.col("pos") + _width(F.col("size")) - F.col("size"), F.lit(0))
    after = F.least(F.col("pos"), latest) + 1
    change = F.explode(F.array(F.struct(first.alias("at"), F.lit(1).alias("n"), F.col("w").alias("w")), F.struct(after.alias("at"), F.lit(-1).alias("n"), (-F.col("w")).alias("w"))))
    changes = hits.select("_h", "size", "least_n", "least_w", change.alias("x")).groupBy("_h", "size", "least_n", "least_w", "x.at").agg(F.sum("x.n").alias("n"), F.sum("x.w").alias("w"))
    order = Window.partitionBy("_h", "size").orderBy("at")
    runs = changes.select("_h", "size", "least_n", "least_w", "at", F.lead("at").over(order).alias("next"), F.sum("n").over(order).alias("n"), F.sum("w").over(order).alias("w"))
    enough = runs.where("next IS NOT NULL AND (n >= least_n OR w >= least_w)")
    starts = enough.groupBy("_h", "size").agg(F.collect_list(F.struct("at", "next")).alias("runs"))
    # Starts that line a shared shingle up with its place in an item, for windows that tie.
    lined = hits.select("_h", "n", "size", "pos", F.explode("backs").alias("back")).select("_h", "size", F.least(F.greatest(F.col("pos") - F.col("back"), F.lit(0)), latest).alias("start"))
    lined = lined.distinct().groupBy("_h", "size").agg(F.collect_list("start").alias("lined"))
    # Shingles that weigh less than 1, per document.
    light = hits.where("w < 1").select("_h", _width(F.col("size")).alias("width"), "h", "w").distinct()
    light = light.groupBy("_h", "width").agg(F.map_from_entries(F.collect_list(F.struct("h", "w"))).alias("light"))
    # Windows of two texts with one hash would be tried on both, and verified on each.
    wanted = written(starts.join(lined, ["_h", "size"]).withColumn("width", _width(F.col("size"))).join(light, ["_h", "width"], "left").drop("width"))

    weight = lambda h: F.coalesce(F.get(F.map_values(F.map_filter("light", lambda k, _: k == h)), F.lit(0)), F.lit(1.0))
    # Words and shingles are columns of their own: inside a lambda they would be built anew for every element.
    # A narrow list of the texts with windows to try picks them out where they lie; only these meet the wide rows.
    listed_texts = written(wanted.select("_h").distinct())
    narrow = F.broadcast(listed_texts) if listed_texts.count() <= BROADCAST_IDS else listed_texts
    few = written(texts.join(narrow, "_h", "left_semi"))
    held = few.join(wanted, "_h").select("_id", "size", "runs", "lined", "light", word_hashes(F.col("_text")).alias("_words"))
    held = held.select("_id", "size", "runs", "lined", "light", _any_width(F.col("_words"), F.col("size"), widths).alias("hashes"))
    weighed = F.when(F.col("light").isNull(), F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(1.0).alias("w")))).otherwise(
        F.transform("hashes", lambda h: F.struct(h.alias("h"), weight(h).alias("w")))
    )
    tried = F.explode(F.flatten(F.transform("runs", lambda x: F.sequence(x["at"], x["next"] - 1))))
    cut = held.select("_id", "size", weighed.alias("all"), "runs", "lined").select("_id", "size", "all", "lined", tried.alias("start"))
    seen = F.array_distinct(F.slice("all", F.col("start") + 1, F.col("size") - _width(F.col("size")) + 1))
    windows = written(cut.select("_id", "size", "start", F.array_contains("lined", F.col("start")).alias("lined"), seen.alias("seen")).withColumn("window", F.xxhash64("size", "seen")))

    # Equal windows are hashed once.
    prints = windows.select("window", "size", "seen").dropDuplicates(["window"]).withColumn("print", simhash(_equal(F.col("seen"))))
    prints = prints.withColumn("weighted_print", F.when(_even(F.col("seen")), F.col("print")).otherwise(simhash(F.col("seen"))))
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("weighs"), F.col("print").alias("print")), F.struct(F.lit(True).alias("weighs"), F.col("weighted_print").alias("print"))))
    prints = prints.select("window", "size", kinds.alias("x")).select("window", "size", "x.weighs", "x.print")
    # Size, kind, block and value as one number: a join on one long needs little memory.
    keyed = prints.select("window", "print", F.explode(F.array(*[_seat(F.col("size"), F.col("weighs"), k, _block(F.col("print"), k)) for k in range(BLOCKS)])).alias("seat"))
    listed = items.withColumn("even", _even(F.col("weighted"))).withColumn("equal_print", simhash(_equal(F.col("weighted"))))
    listed = listed.withColumn("weighted_print", F.when(F.col("even"), F.col("equal_print")).otherwise(simhash(F.col("weighted"))))
    kinds = F.explode(
        F.array(
            F.struct(F.lit(False).alias("weighs"), F.col("equal_print").alias("item_print"), F.lit(False).alias("wide")),
            F.struct(F.lit(True).alias("weighs"), F.col("weighted_print").alias("item_print"), (~F.col("even")).alias("wide")),
        )
    )
    listed = listed.select("seq", "size", kinds.alias("x")).select("seq", "size", "x.*")
    listed = listed.withColumn("blocks", F.array(*[_block(F.col("item_print"), k) for k in range(BLOCKS)]))
    listed = listed.withColumn("near", F.when(F.col("wide"), _near(WIDE_BLOCK_RADIUS)).otherwise(_near(BLOCK_RADIUS)))
    probes = F.flatten(F.transform("blocks", lambda b, k: F.transform("near", lambda m: _seat(F.col("size"), F.col("weighs"), k, b.bitwiseXOR(m)))))
    radius = F.when(F.col("wide"), WIDE_RADIUS).otherwise(RADIUS)
    listed = listed.select("seq", "item_print", radius.alias("radius"), F.explode_outer(probes).alias("seat"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    met = keyed.join(listed, "seat").withColumn("distance", distance).where("distance <= radius").groupBy("window", "seq").agg(F.min("distance").alias("distance"))

    pairs = windows.join(met, "window").join(items.select("seq", "weighted"), "seq")
    inside = F.filter("weighted", lambda x: F.array_contains(F.transform("seen", lambda y: y["h"]), x["h"]))
    scored = pairs.withColumn("inside", inside).withColumn("common", _total(F.col("inside"))).withColumn("n_common", F.size("inside"))
    by_weight = F.col("common") / (_total(F.col("weighted")) + _total(F.col("seen")) - F.col("common"))
    by_number = F.col("n_common") / (F.size("weighted") + F.size("seen") - F.col("n_common"))
    kept = scored.withColumn("similarity", F.round(F.greatest(by_weight, by_number), 12)).where(F.col("similarity") >= similarity - 1e-9)
    kept = kept.select("_id", "seq", "start", "lined", "size", "distance", "similarity").join(ids.select("seq", "_item"), "seq")
    best = kept.groupBy("_id", "_item").agg(F.max(F.struct("similarity", "lined", (-F.col("start")).alias("at"), "size", (-F.col("distance")).alias("near"))).alias("b"))
    return best.select(
        F.col("_id").alias(id_col),
        F.col("_item").alias(item_id),
        (-F.col("b.at")).cast("long").alias("first_word"),
        F.col("b.size").cast("long").alias("n_words"),
        (-F.col("b.near")).alias("distance"),
        F.round("b.similarity", 9).alias("similarity"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark; all columns stay. Null ids stay."""
    leaking = find_leaks(docs, benchmark, similarity, id_col, text_col).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(leaking, docs[id_col] == leaking["_gone"], "left_anti")
