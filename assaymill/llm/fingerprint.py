"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A document's distinct paragraphs are hashed to digests. Each digest is added to
one cell in each of three small tables; a cell holds the number of its digests,
their exclusive or, and the exclusive or of their check sums. Subtracting the
sketches of two versions leaves the digests that differ; cells with one of them
are peeled off, which lays open further cells, until every differing digest is
recovered.

Where peeling gets stuck there are more differences than the sketch can hold. It
is retried with a sketch four times as large: the digests are dealt by further
bits of theirs to four sketches of the same form, so that each step stays small
however long the documents are. Only the parts that failed grow again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill.llm.common import text_of, written

TABLES, CELLS = 3, 4  # cells per table: two bits of the digest
ROUNDS = 13  # of peeling; each empties a cell at least, or changes nothing any more
PART_ROWS, MAX_PARTS = 2000, 8192


def digests(text: Column) -> Column:
    """Hashes of the distinct paragraphs: lines with more than white space."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _sits(digest: Column, cell: Column) -> Column:
    """Whether the digest belongs to the cell (0 to 11)."""
    shifted = F.call_function("shiftright", digest, (F.floor(cell / CELLS) * 2).cast("int"))
    return shifted.bitwiseAND(F.lit(CELLS - 1).cast("long")) == cell % CELLS


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF))


def _folded(entries: Column, of) -> Column:
    return F.aggregate(entries, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(of(x)))


def sketch(keys: Column) -> Column:
    """The cells (n, k, s) of an array of digests."""

    def cell(j: Column) -> Column:
        own = F.filter(keys, lambda d: _sits(d, j))
        return F.struct(F.size(own).alias("n"), _folded(own, lambda d: d).alias("k"), _folded(own, _check).alias("s"))

    return F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), cell)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["s"].bitwiseXOR(y["s"]).alias("s")))


def peel(cells: Column) -> Column:
    """(cells left, found): the differing digests with their sign, +1 where only the first has one."""
    empty = F.array().cast("array<struct<k:bigint,n:int>>")

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["s"] == _check(c["k"]))), lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")))
        )

        def less(c: Column, j: Column) -> Column:
            own = F.filter(state["pure"], lambda p: _sits(p["k"], j))
            return F.struct(
                (c["n"] - F.aggregate(own, F.lit(0), lambda s, p: s + p["n"])).alias("n"),
                c["k"].bitwiseXOR(_folded(own, lambda p: p["k"])).alias("k"),
                c["s"].bitwiseXOR(_folded(own, lambda p: _check(p["k"]))).alias("s"),
            )

        # Two half steps, so that what is found is computed once: take the pure keys out, then look again.
        taken = F.when(F.size(state["pure"]) > 0, F.transform(state["cells"], less)).otherwise(state["cells"])
        return F.when(
            F.size(state["pure"]) > 0,
            F.struct(taken.alias("cells"), empty.alias("pure"), F.concat(state["found"], state["pure"]).alias("found")),
        ).otherwise(F.struct(state["cells"].alias("cells"), pure.alias("pure"), state["found"].alias("found")))

    start = F.struct(cells.alias("cells"), empty.alias("pure"), empty.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start, step)


def _clear(peeled: Column) -> Column:
    return F.forall(peeled["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["s"] == 0))


def as_text(cells: Column) -> Column:
    """The sketch as a string: count, digests and check sums of each cell in hexadecimal."""
    return F.concat_ws(".", F.transform(cells, lambda c: F.concat_ws("-", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["s"]))))


def likeness(different: Column, a: Column, b: Column) -> Column:
    """Share of both documents' paragraphs that do not differ; 1 for two documents without any."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(1.0 - different / (a + b))


def differences(pairs: DataFrame) -> DataFrame:
    """(_row, kind, different) for ``pairs`` (_row, kind, a, b): digest arrays of any length, growing until all peel."""
    level, solved, rest = 0, [], pairs
    while True:
        tried = rest.withColumn("p", peel(subtract(sketch(F.col("a")), sketch(F.col("b")))))
        tried = written(
            tried.select("_row", "kind", F.size("p.found").alias("different"), _clear(F.col("p")).alias("clear"), "a", "b").select(
                "_row", "kind", F.when(F.col("clear"), F.col("different")).alias("different"), *[F.when(~F.col("clear"), F.col(c)).alias(c) for c in ("a", "b")]
            )
        )
        solved.append(tried.where("different IS NOT NULL").select("_row", "kind", "different"))
        rest = tried.where("different IS NULL")
        if level == 29 or rest.isEmpty():
            break
        rest = _dealt(rest, level)
        level += 1
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out.groupBy("_row", "kind").agg(F.sum("different").alias("different"))


def _dealt(rows: DataFrame, level: int) -> DataFrame:
    """Split both sides of each row by two more bits of the digests."""
    shift = 6 + 2 * level

    def part(c: str, k: Column) -> Column:
        return F.filter(c, lambda d: F.shiftrightunsigned(d, shift).bitwiseAND(F.lit(3).cast("long")) == k)

    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(part("a", k).alias("a"), part("b", k).alias("b")))
    return rows.select("_row", "kind", F.explode_outer(parts).alias("x")).select("_row", "kind", "x.a", "x.b").where("size(a) + size(b) > 0")


def _part(bounds: list[int], value: Column) -> Column:
    """How many of the falling bounds lie above the value, by two steps of about their root."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    rows = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    group = F.size(F.filter(heads, lambda h: h > value)) - 1
    inner = F.size(F.filter(F.get(rows, F.greatest(group, F.lit(0))), lambda h: h > value))
    return F.when(value.isNull(), len(bounds)).when(group < 0, 0).otherwise(group * step + inner)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _next): every text with that of the next document in falling id order; the first follows the last.

    Ids are cut into ranges of about ``PART_ROWS`` rows. Each range ends with a
    copy of the first text of the next one, so no step sorts more than a range.
    Rows with a null id come last; rows with one id are ordered by their text's hash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    n = rows.count()
    parts = min(MAX_PARTS, -(-n // PART_ROWS))
    quantiles = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx("_id", quantiles, 100 * parts).alias("q")).first()["q"] if quantiles else None
    bounds = sorted(set(found or []), reverse=True)
    dealt = rows.select(_part(bounds, F.col("_id")).alias("part"), "_id", F.xxhash64("_text").alias("h"), "_text", F.lit(True).alias("own"))
    rank = F.struct(F.col("_id").isNotNull(), "_id", "h")
    firsts = written(dealt.groupBy("part").agg(F.max_by(F.struct("_id", "h", "_text"), rank).alias("f")))
    # One row per range, at most MAX_PARTS.
    order = Window.orderBy("part")
    before = firsts.select("part").withColumn("before", F.lag("part").over(order)).withColumn("last", F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = firsts.join(before, "part").select(F.coalesce("before", "last").alias("part"), "f._id", "f.h", "f._text", F.lit(False).alias("own"))
    inside = Window.partitionBy("part").orderBy(F.desc("own"), F.desc_nulls_last("_id"), F.desc("h"))
    return dealt.unionByName(ends).withColumn("_next", F.lead("_text").over(inside)).where("own").select("_id", "_text", "_next")


def edit(text: Column, following: Column) -> Column:
    """The last half of the characters replaced by as many of the following text's first, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    The edited text ends with the beginning of the next document in falling id
    order. Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per row. Null texts count as empty; texts without
    paragraphs have an empty sketch and are alike to each other. Null ids come
    last in the order. Equal rows are documents of their own. A single row is its
    own next document. Other columns are ignored.
    """
    texts = with_next(docs, id_col, text_col).withColumn("_edited", edit(F.col("_text"), F.col("_next")))
    keyed = texts.select(
        F.monotonically_increasing_id().alias("_row"),
        "_id",
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("_text")).alias("a"),
        digests(F.col("_edited")).alias("b"),
        digests(F.col("_next")).alias("c"),
    )
    keyed = written(keyed)
    pairs = keyed.select("_row", F.explode(F.array(F.struct(F.lit(1).alias("kind"), "a", F.col("b").alias("b")), F.struct(F.lit(2).alias("kind"), "a", F.col("c").alias("b")))).alias("x"))
    different = differences(pairs.select("_row", "x.kind", "x.a", "x.b"))
    both = different.groupBy("_row").agg(*[F.max(F.when(F.col("kind") == k, F.col("different"))).alias(f"d{k}") for k in (1, 2)])
    sizes = [F.size(c) for c in ("a", "b", "c")]
    near = keyed.join(both, "_row")
    return near.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(sketch(F.col("a"))).alias("fingerprint"),
        as_text(sketch(F.col("b"))).alias("edited_fingerprint"),
        likeness(F.col("d1"), sizes[0], sizes[1]).alias("near_edited"),
        likeness(F.col("d2"), sizes[0], sizes[2]).alias("near_next"),
    )
