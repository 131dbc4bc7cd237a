"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of source s is repeated Poisson(r) times, where r is the source's
target repetition rate: its weight times the target number of rows, over its own
number of rows. The count is the inverse of the Poisson distribution at a number
in [0, 1) hashed from the seed and the document, so any executor gets the same
count for a row at any time. A rate above ``PIECE`` is the sum of equal pieces with
a hash of their own each, which is again Poisson and needs no long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import text_of, without, written

PIECE = 16.0
# Beyond this many terms the distribution of a piece is closer to 1 than 52 bits can tell.
TERMS = 100
OUTPUT = ("replica", "shuffle_key")


def _uniform(text: Column) -> Column:
    """52 hashed bits as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(rate: Column) -> Column:
    """The cumulative Poisson probabilities of 0, 1, ... TERMS."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.exp(k * F.log(rate) - rate - F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i))))
    return F.aggregate(terms, F.array().cast("array<double>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + p)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, power: float = 0.5, source_col: str = "source") -> DataFrame:
    """(_source, n_rows, rate) per source.

    ``weights``: target share of rows per source, of any positive sum; sources
    without a weight get none. By default a source's share grows with its number
    of rows to the ``power``, which lifts small sources. ``target_rows``: rows
    aimed at, as many as there are by default. A null source is a source.
    """
    counted = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weighted = counted.withColumn("w", F.pow(F.col("n_rows").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "_given string, w double")
        weighted = counted.join(given, F.col("_source").cast("string").eqNullSafe(F.col("_given")), "left").select("_source", "n_rows", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighted = written(weighted)
    total = weighted.agg(F.sum("w").alias("w"), F.sum("n_rows").alias("n"))
    aim = F.col("t.n") if target_rows is None else F.lit(target_rows)
    rate = F.when(F.col("s.w") > 0, F.col("s.w") / F.col("t.w") * aim / F.col("s.n_rows")).otherwise(0.0)
    return weighted.alias("s").join(F.broadcast(total.alias("t"))).select("_source", "s.n_rows", rate.alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    target_rows: int | None = None,
    power: float = 0.5,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Repeat every row a Poisson number of times and shuffle all of them.

    Returns all columns, ``replica`` (from 1) and ``shuffle_key``, the random order:
    rows are dealt to partitions by it and sorted within them. Rows are hashed by
    id, those with a null id by their text; rows that repeat an id get the same
    count. Null texts are kept like any other, a null source is a source of its
    own. Input columns named like a result are replaced. An empty table gives an
    empty result.
    """
    docs = without(docs, [*OUTPUT, "_source", "_name", "_rate", "_pieces", "_cdf", "_count"])
    table = rates(docs, weights, target_rows, power, source_col).where("rate > 0")
    table = table.select("_source", F.ceil(F.col("rate") / PIECE).alias("_pieces"), "rate").select("_source", "_pieces", _distribution(F.col("rate") / F.col("_pieces")).alias("_cdf"))
    # Small by nature, one row per source; Spark sees its size and picks the join.
    table = written(table)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), text_of(text_col)))
    joined = docs.withColumn("_name", F.md5(name)).join(table, docs[source_col].eqNullSafe(table["_source"]))

    def piece(k: Column) -> Column:
        u = _uniform(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), F.col("_name")))
        return F.size(F.filter("_cdf", lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_pieces").cast("int")), piece), F.lit(0), lambda a, b: a + b)
    copies = joined.withColumn("_count", count).where("_count > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.col("replica").cast("string"), F.col("_name"))))
    return keyed.select(*docs.columns, *OUTPUT).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
