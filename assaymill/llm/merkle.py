"""Merkle manifest of a dataset with nested-interval labels, in DataFrame functions.

A row's leaf is the SHA-256 of its fields, each with its length. Inside a group
(a language, a shard) leaves are ranked by id, and runs of ``FAN`` nodes become one
node above them, until one is left: the group's subroot. The subroots are the leaves
of one more tree of the same kind; what is left of that is the root.

Every node carries the interval [lo, hi) of leaf ranks that it covers. A node of level
L starts at a multiple of FAN**L, so "which node of level L contains this interval" is
an equality on (group, lo - lo % FAN**L): a containment join in buckets of that level.
Inside a parent, the children that end where a node starts, or before, are its left
siblings, and those that start where it ends, or later, the right ones. Proofs go down
from the roots: a node's proof is its siblings followed by its parent's proof, so each
proof of a run is built once and joined once.

Ranks need no window over rows: rows are sorted by range over all tasks, and a rank is
the place in the range plus the counts of the group in earlier ranges. A group with
most of the rows is therefore many ranges. Levels shrink eightfold; there are about
log8(rows) of them.

Defined for awkward rows: a null field is ``-`` and differs from every value; a null
group is a group, and comes first; null ids come first, rows with the same id are
ordered by their leaf, and equal rows are leaves of their own; an empty table has no
node and an empty manifest; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import written

FAN = 8
# Rows of one sorted range; below that, as many ranges as Spark has shuffle partitions.
RANGE_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for null, otherwise the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The leaf digest, lower-case hex."""
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to by the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings_of(proof: Column) -> Column:
    """All siblings of ``proof``, joined: level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with lo and hi, the interval of their rank in ``_group``, and _n, the group's rows."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    by = [F.col("_group"), *order]
    # The id counts up inside a task and has the task's number in its upper bits.
    sorted_rows = written(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftrightunsigned("_at", 33))
    counts = sorted_rows.groupBy("_group", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # Ranges plus groups many rows.
    offsets = counts.selectExpr(
        "_group",
        "_range",
        "coalesce(sum(_rows) OVER (PARTITION BY _group ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - _first AS _shift",
        "sum(_rows) OVER (PARTITION BY _group) AS _n",
    )
    placed = sorted_rows.join(written(offsets), ["_group", "_range"]).withColumn("lo", F.col("_at") + F.col("_shift"))
    return placed.withColumn("hi", F.col("lo") + 1).drop("_at", "_range", "_shift")


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of ``level``: runs of FAN intervals below, with these as ``children``."""
    width = FAN**level
    inner = [c for c in nodes.columns if c not in ("_group", "_n")]
    return (
        nodes.withColumn("_start", F.col("lo") - F.col("lo") % width)
        .groupBy("_group", "_n", "_start")
        .agg(F.sort_array(F.collect_list(F.struct("lo", *[c for c in inner if c != "lo"]))).alias("children"))
        .select("_group", "_n", F.col("_start").alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), F.sha2(F.array_join("children.digest", ""), 256).alias("digest"), "children")
    )


def _grow(leaves: DataFrame) -> list[DataFrame]:
    """All levels above ``leaves``, from the lowest; each group stops at its one last node."""
    most = leaves.agg(F.max("_n")).first()[0] or 0
    levels, below = [], leaves
    while FAN ** len(levels) < most:
        nodes = written(_above(below.where(F.col("_n") > FAN ** len(levels)), len(levels) + 1))
        levels.append(nodes)
        below = nodes.drop("children")
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(_group, digest): the last node of each group."""
    found = leaves.where("_n = 1").select("_group", "digest")
    for k, nodes in enumerate(levels):
        found = found.union(nodes.where(F.col("_n") <= FAN ** (k + 1)).select("_group", "digest"))
    return found


def _attach(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``leaves`` with the columns of ``tops`` (one row per group) and their whole ``proof``.

    ``tops`` has the proof of each group's last node; going down, each child's siblings
    are put before the proof of its parent.
    """
    carried = [c for c in tops.columns if c != "_group"]
    own = [c for c in leaves.columns if c not in ("_group", "_n")]
    reached = None  # (_group, lo, carried): the nodes of the level at hand, but for last nodes
    for k in reversed(range(len(levels))):
        last = F.col("_n") <= FAN ** (k + 1)
        with_proof = levels[k].where(last).join(tops, "_group")
        if reached is not None:
            with_proof = with_proof.unionByName(levels[k].where(~last).join(reached, ["_group", "lo"]).select(with_proof.columns))
        below = with_proof.select("_group", "_n", F.explode("children").alias("_child"), "children", *carried)
        left = F.array_join(F.filter("children", lambda c: c["hi"] <= F.col("_child.lo"))["digest"], "")
        right = F.array_join(F.filter("children", lambda c: c["lo"] >= F.col("_child.hi"))["digest"], "")
        proof = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("proof"))
        kept = ["lo"] if k else own
        reached = below.select("_group", "_n", *[F.col(f"_child.{c}").alias(c) for c in kept], proof.alias("proof"), *[c for c in carried if c != "proof"])
        if k:
            reached = reached.drop("_n")
    alone = leaves.where("_n = 1").join(tops, "_group").select("_group", "_n", *own, "proof", *[c for c in carried if c != "proof"])
    return alone if reached is None else reached.unionByName(alone)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns of ``keep``, leaf, proof, subroot and root.

    ``proof`` is array<struct<left, right>>: per level, from the leaf to the root, the
    joined digests of the siblings on either side. ``fold(leaf, proof)`` is the root.
    """
    keep = keep or {}
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = docs.select(
        group.alias("_group"),
        F.col(id_col).alias("_id"),
        leaf_of(*[F.col(c) for c in fields]).alias("digest"),
        F.monotonically_increasing_id().alias("_salt"),  # so that a range can end inside a run of equal rows
        *[expression.alias(f"_keep{k}") for k, expression in enumerate(keep.values())],
    )
    leaves = _ranked(written(rows), [F.col("_id").asc_nulls_first(), F.col("digest"), F.col("_salt")]).drop("_salt")
    levels = _grow(leaves)
    subroots = written(_tops(leaves, levels).select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "digest"))
    upper = written(_ranked(subroots, [F.col("_name")]))
    upper_levels = _grow(upper)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = _tops(upper, upper_levels).select("_group", F.col("digest").alias("root"), none.alias("proof"))
    tops = _attach(upper, upper_levels, root).select(F.col("_name").alias("_group"), F.col("digest").alias("subroot"), "root", "proof")
    return _attach(leaves, levels, written(tops)).select(F.col("_id").alias(id_col), *[F.col(f"_keep{k}").alias(name) for k, name in enumerate(keep)], F.col("digest").alias("leaf"), "subroot", "root", "proof")
