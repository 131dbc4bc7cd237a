"""Positions, ranks and prefix sums of very large ordered tables.

A window without a partition key, or with a key that holds a third of the rows,
sorts everything in one task. Here the value range is cut into buckets first:

1. quantile sketches, of all columns in one pass, give cut points; a value so frequent that it spans
   several of them becomes a bucket of its own, divided further by a hash of the
   row id, which is also the tie-break, so the order stays exact;
2. one aggregation gives rows and sums per (group, bucket), and a running sum
   over that small table says what lies before each bucket;
3. a window inside a bucket, plus the offset, gives the exact global answer.

Cut points decide only how work is divided, never a result; their number follows
from the number of rows. When single positions are wanted, only the buckets that
hold them are shuffled at all.

Rows without a finite value have no place in the order: they are not counted, and
their rank is NULL. A NULL group is a group.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill.operators.clean import finite, finite_rows, join_null_safe
from assaymill.session import written

ROWS_PER_BUCKET = 1_000_000
# Quantiles asked for at least, so that frequent values show.
QUANTILES = 2048
# Size of a quantile sketch: ranks are right to about a thousandth of the rows.
SKETCH = 2048


@dataclass(frozen=True)
class Cuts:
    splits: list[float]
    frequent: list[int]
    buckets: int = 1

    def assign(self, df: DataFrame, column: str) -> DataFrame:
        out = Bucketizer(splits=self.splits, inputCol=column, outputCol="_bucket").transform(df)
        return out.withColumn("_bucket", F.col("_bucket").cast("int"))

    def is_frequent(self) -> Column:
        return F.col("_bucket").isin(self.frequent) if self.frequent else F.lit(False)


def cut_points_of(df: DataFrame, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> list[Cuts]:
    """Cut points of several columns from one pass: a mergeable quantile sketch and a count each."""
    spark = df.sparkSession
    sketches = df.agg(*[x for c in columns for x in (F.kll_sketch_agg_double(F.col(c).cast("double"), SKETCH), F.count(c))]).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, plans, asked = [], [], []
    for k in range(len(columns)):
        sketch, n = sketches[2 * k], sketches[2 * k + 1]
        buckets = max(1, math.ceil(n / rows_per_bucket), min(least, n))
        number = max(QUANTILES, 2 * buckets)
        plans.append((sketch, n, buckets, number))
        if n:
            probs = F.from_json(F.lit(json.dumps([i / number for i in range(1, number)])), "array<double>")
            asked.append(F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), probs))
    answers = iter(spark.range(1).select(*asked).first() if asked else ())
    for _, n, buckets, number in plans:
        cuts.append(_cuts(list(next(answers)) if n else [], buckets, number))
    return cuts


def _cuts(quantiles: list[float], buckets: int, number: int) -> Cuts:
    step = number / buckets
    kept = {float(quantiles[min(len(quantiles) - 1, round(i * step) - 1)]) for i in range(1, buckets)} if quantiles else set()
    share: dict[float, int] = {}
    for q in quantiles:
        share[float(q)] = share.get(float(q), 0) + 1
    heavy = {v for v, hits in share.items() if hits >= 2 * step and hits >= 2}
    inner = sorted(kept | heavy | {math.nextafter(v, math.inf) for v in heavy})
    splits = [-math.inf, *(inner or [0.0]), math.inf]
    return Cuts(splits, [splits.index(v) for v in sorted(heavy)], buckets)


def cut_points(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Cuts:
    return cut_points_of(df, [column], rows_per_bucket)[0]


def _tie(row_id: str) -> Column:
    return F.md5(F.col(row_id).cast("string"))


def hex_digits(parts: int) -> int:
    """Digits of a hexadecimal hash that give at least ``parts`` different prefixes, and never under 4096."""
    return max(3, math.ceil(math.log(max(1, parts), 16)))


def _divided(df: DataFrame, column: str, row_id: str, cuts: Cuts) -> DataFrame:
    part = F.when(cuts.is_frequent(), F.substring(_tie(row_id), 1, hex_digits(cuts.buckets))).otherwise("")
    return cuts.assign(df, column).withColumn("_part", part)


def _offsets(df: DataFrame, by: Sequence[str], keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Rows and sums per bucket, and of all buckets before it, per group."""
    cells = df.groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_{s}") for s in sums]
    )
    before = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    extra = {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(*by))}
    for s in sums:
        extra[f"_before_{s}"] = F.coalesce(F.sum(f"_{s}").over(before), F.lit(0.0))
    return cells.withColumns(extra)


def rows_at(
    df: DataFrame,
    column: str,
    row_id: str,
    wanted: Callable[[Column], list[tuple[Column, Column]]],
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The rows at given positions of each group, in ascending order of ``column``.

    ``wanted`` gets the group's row count and returns (label, position) pairs,
    positions from 1. Result: group, ``label``, ``position``, ``n``, ``value`` and
    for each sum its total over all rows up to the position.
    """
    # Read several times below, so the few columns are written once.
    df = written(finite_rows(df.select(*by, row_id, column, *[s for s in sums if s not in (column, row_id, *by)]), column))
    cuts = cut_points(df, column, rows_per_bucket)
    keys = ["_bucket", "_part"]
    split = _divided(df, column, row_id, cuts)
    cells = _offsets(split, by, keys, sums)
    ask = F.array(*[F.struct(a.alias("label"), p.cast("long").alias("position")) for a, p in wanted(F.col("_total"))])
    here = F.filter(
        ask, lambda w: (w["position"] > F.col("_before")) & (w["position"] <= F.col("_before") + F.col("_n"))
    )
    hits = cells.withColumn("_ask", here).where(F.size("_ask") > 0)
    hits = written(hits.select(*by, *keys, "_before", "_total", "_ask", *[f"_before_{s}" for s in sums]))
    # Rows carry only the offsets of their bucket; labels meet the finished
    # positions in a second small join.
    offsets = hits.select(*by, *keys, "_before", *[f"_before_{s}" for s in sums])
    asked = hits.select(*by, F.col("_total").alias("n"), F.inline("_ask"))
    inside = join_null_safe(split, offsets, [*by, *keys])
    order = Window.partitionBy(*by, *keys).orderBy(column, _tie(row_id), row_id)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.select(
        *by,
        F.col(column).alias("value"),
        (F.col("_before") + F.row_number().over(order)).cast("long").alias("position"),
        *[(F.col(f"_before_{s}") + F.sum(s).over(upto)).alias(f"{s}_upto") for s in sums],
    )
    return join_null_safe(ranked, asked, [*by, "position"])


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str], rows_per_bucket: int) -> list[tuple[Cuts, DataFrame]]:
    """Per column its cut points, and rows per bucket with those before; counted together."""
    cuts = cut_points_of(df, columns, rows_per_bucket)
    marked = df
    for k, column in enumerate(columns):
        marked = cuts[k].assign(marked, column).withColumnRenamed("_bucket", f"_bucket{k}")
    each = F.array(*[F.struct(F.lit(k).alias("_column"), F.col(f"_bucket{k}").alias("_bucket")) for k in range(len(columns))])
    cells = written(_offsets(marked.select(*by, F.inline(each)), [*by, "_column"], ["_bucket"]).select(*by, "_column", "_bucket", "_n", "_before"))
    return [(c, cells.where(F.col("_column") == k).drop("_column")) for k, c in enumerate(cuts)]


def _ranked(df: DataFrame, column: str, row_id: str, out: str, by: Sequence[str], cuts: Cuts, cells: DataFrame) -> DataFrame:
    base = cuts.assign(df, column)
    salt = F.when(cuts.is_frequent(), F.pmod(F.xxhash64(row_id), F.lit(max(QUANTILES, cuts.buckets)))).otherwise(F.lit(0))
    rows = join_null_safe(base.withColumn("_salt", salt), cells, [*by, "_bucket"])
    # As many tasks as the rows ask for: their memory does not grow with the table.
    rows = rows.repartition(cuts.buckets, *by, "_bucket", "_salt")
    inside = Window.partitionBy(*by, "_bucket", "_salt")
    ties = Window.partitionBy(*by, "_bucket", "_salt", column)
    rank = F.rank().over(inside.orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    whole = (F.col("_n") + 1) / 2.0
    placed = F.col("_before") + F.when(cuts.is_frequent(), whole).otherwise(rank)
    return rows.withColumn(out, placed.cast("double")).drop("_bucket", "_salt", "_n", "_before")


def average_rank(
    df: DataFrame, column: str, row_id: str, out: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rank from 1 with ties sharing their mean rank; NULL where the value is not finite."""
    known = finite_rows(df, column)
    ranked = _ranked(known, column, row_id, out, by, *_cells(known, [column], by, rows_per_bucket)[0])
    rest = df.where(~finite(F.col(column))).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(rest)


def spearman(df: DataFrame, a: str, b: str, row_id: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rank correlation over the rows where both values are finite."""
    from assaymill.operators.agreement import grouped, pearson

    slim = written(finite_rows(df.select(*by, row_id, a, b), a, b))
    ranked = slim
    # Cut points and offsets come from the written rows, not from the first ranking.
    for column, out, cells in zip((a, b), ("_ra", "_rb"), _cells(slim, [a, b], by, rows_per_bucket)):
        ranked = _ranked(ranked, column, row_id, out, by, *cells)
    return grouped(ranked, by, False, F.count(a).alias("n"), pearson(F.col("_ra"), F.col("_rb")).alias("spearman_rho"))


def exact_quantiles(
    df: DataFrame, column: str, row_id: str, probs: dict[str, float], by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Linear-interpolated quantiles without holding a group in one task."""

    def wanted(n: Column) -> list[tuple[Column, Column]]:
        out = []
        for name, q in probs.items():
            spot = (n - 1) * F.lit(q)
            out += [(F.lit(f"{name}:lo"), F.floor(spot) + 1), (F.lit(f"{name}:hi"), F.ceil(spot) + 1)]
        return out

    rows = rows_at(df, column, row_id, wanted, by, (), rows_per_bucket)
    columns = []
    for name, q in probs.items():
        lo = F.max(F.when(F.col("label") == f"{name}:lo", F.col("value")))
        hi = F.max(F.when(F.col("label") == f"{name}:hi", F.col("value")))
        spot = (F.max("n") - 1) * F.lit(q)
        columns.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    n = F.max("n").alias("n")
    return rows.groupBy(*by).agg(n, *columns) if by else rows.agg(n, *columns)


def distribution_line(
    df: DataFrame, column: str, row_id: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Minimum, the value at index n // 10, median and maximum."""

    def wanted(n: Column) -> list[tuple[Column, Column]]:
        return [
            (F.lit("lowest"), F.lit(1)),
            (F.lit("p10"), F.floor(n / 10) + 1),
            (F.lit("median_lo"), F.floor((n - 1) / 2) + 1),
            (F.lit("median_hi"), F.ceil((n - 1) / 2) + 1),
            (F.lit("highest"), n),
        ]

    rows = rows_at(df, column, row_id, wanted, by, (), rows_per_bucket)

    def at(label: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col("value")))

    columns = [
        F.max("n").alias("n"),
        at("lowest").alias("lowest"),
        at("p10").alias("p10"),
        ((at("median_lo") + at("median_hi")) / 2.0).alias("median"),
        at("highest").alias("highest"),
    ]
    return rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)


def positions(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], out: str = "position") -> DataFrame:
    """Global position from 1 where ``bucket`` already follows the order."""
    base = df.withColumn("_bucket", bucket)
    cells = written(_offsets(base, by, ["_bucket"]).select(*by, "_bucket", "_before", "_total"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = join_null_safe(base, cells, [*by, "_bucket"]).withColumn(out, F.col("_before") + F.row_number().over(inside))
    return ranked.withColumnRenamed("_total", f"{out}_of").drop("_bucket", "_before")
