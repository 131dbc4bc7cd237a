"""Leak-proof splits, reproducible in any engine.

The order is the md5 of seed and id. Its first digits are uniform, so they cut
the ids into even buckets without looking at the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import DEFAULTS
from assaymill.operators.ordered import ROWS_PER_BUCKET, hex_digits, positions
from assaymill.session import written


def shuffle_key(row_id: str, seed: int = DEFAULTS.seed) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))


def shuffled(df: DataFrame, row_id: str, by: Sequence[str] = (), seed: int = DEFAULTS.seed) -> DataFrame:
    """Distinct ids with their place (from 0) in a seeded order of each group.

    NULL is a group. An id that is listed with several groups takes the smallest.
    """
    ids = df.select(row_id, *by).distinct()
    if by:
        ids = ids.groupBy(row_id).agg(F.min(F.struct(*by)).alias("_by")).select(row_id, "_by.*")
    ids = ids.withColumn("_key", shuffle_key(row_id, seed))
    digits = hex_digits(-(-df.count() // ROWS_PER_BUCKET))
    placed = positions(ids, by, F.substring("_key", 1, digits), ["_key", row_id], "_place")
    return placed.withColumn("_place", F.col("_place") - 1).withColumnRenamed("_place_of", "_size").drop("_key")


def at_least_one(share: Column) -> Column:
    """Rounded half to even, but never empty."""
    return F.greatest(F.lit(1), F.rint(share).cast("long"))


def kfold(
    df: DataFrame,
    row_id: str,
    n_splits: int = 5,
    seed: int = DEFAULTS.seed,
    val_fraction: float = 0.2,
    strata: Sequence[str] = (),
) -> DataFrame:
    """(fold, id, split): contiguous test blocks, then validation, then training.

    With ``strata`` the blocks are cut inside every stratum.
    """
    if n_splits < 2 or not 0.0 < val_fraction < 1.0:
        raise ValueError("n_splits must be at least 2 and val_fraction inside (0, 1)")
    rows = shuffled(df, row_id, strata, seed).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    n, place, fold = F.col("_size"), F.col("_place"), F.col("fold")
    start = F.floor(fold * n / n_splits)
    stop = F.floor((fold + 1) * n / n_splits)
    rest = n - (stop - start)
    index = F.when(place < start, place).otherwise(place - (stop - start))
    split = (
        F.when((place >= start) & (place < stop), "test")
        .when(index < at_least_one(rest * F.lit(val_fraction)), "val")
        .otherwise("train")
    )
    return rows.select("fold", row_id, split.alias("split"))


def with_records(folds: DataFrame, records: DataFrame, row_id: str) -> DataFrame:
    """Each fold's assignment with the records it assigns; an id without a record keeps NULLs."""
    return folds.join(records, row_id, "left")


def stratified_split(
    df: DataFrame, row_id: str, stratum: str, val_fraction: float = 0.2, seed: int = DEFAULTS.seed
) -> DataFrame:
    """One train/val/test split that deals ids out of the strata in turn.

    Turn i takes from stratum ``i % S``; validation is filled first, then test.
    The place of an id in the dealing order follows from its place inside its
    stratum and the sizes of the strata, so no global sort is needed. NULL is a
    stratum, the first one.
    """
    rows = written(shuffled(df, row_id, [stratum], seed))
    known = F.struct(F.col(stratum).isNotNull().alias("known"), F.col(stratum).alias("s"))
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    table = sizes.agg(F.array_sort(F.collect_list(F.struct(known.alias("s"), "n")))).scalar()
    rows = rows.withColumn("_strata", table)
    s, place = known, F.col("_place")
    ahead = F.aggregate(
        "_strata",
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.least(x["n"], place + F.when(x["s"] < s, 1).otherwise(0)),
    )
    n = F.aggregate("_strata", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    number = F.aggregate("_strata", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["s"] < s, 1).otherwise(0))
    rows = rows.withColumns({"_turn": place * F.size("_strata") + number, "_ahead": ahead, "_n": n})
    quota = at_least_one(F.col("_n") * F.lit(val_fraction))
    split = (
        F.when(F.col("_turn") >= F.col("_n"), "train")
        .when(F.col("_ahead") < quota, "val")
        .when(F.col("_ahead") < 2 * quota, "test")
        .otherwise("train")
    )
    return rows.select(row_id, stratum, split.alias("split"))


def site_holdout(df: DataFrame, row_id: str, site: str, sites: Sequence[str]) -> DataFrame:
    """(fold, id, split) for every ordered pair of sites: train on one, test on the other."""
    if len(set(sites)) < 2:
        raise ValueError("a site holdout needs at least two sites")
    own = F.col(site)
    others = F.array_except(F.array(*[F.lit(s) for s in sites]), F.array(own))
    cells = F.flatten(
        F.transform(
            others,
            lambda o: F.array(
                F.struct(F.concat(own, F.lit("->"), o).alias("fold"), F.lit("train").alias("split")),
                F.struct(F.concat(o, F.lit("->"), own).alias("fold"), F.lit("test").alias("split")),
            ),
        )
    )
    known = df.where(own.isin(*sites))
    return known.select(row_id, F.inline(cells)).select("fold", row_id, "split")


def holdout_sizes(df: DataFrame, site: str, sites: Sequence[str]) -> DataFrame:
    """(fold, n_train, n_test) of every ordered pair, from one count per site; 0 where a site has no rows."""
    counts = df.where(F.col(site).isin(*sites)).groupBy(F.col(site).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame([(s,) for s in sites], "s string").join(counts, "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n"))
    a, b = listed.alias("a"), listed.alias("b")
    pairs = a.join(b, F.col("a.s") != F.col("b.s"))
    return pairs.select(F.concat("a.s", F.lit("->"), "b.s").alias("fold"), F.col("a.n").alias("n_train"), F.col("b.n").alias("n_test"))


def without_site(df: DataFrame, row_id: str, site: str, sites: Sequence[str] | None = None) -> DataFrame:
    """Rows a site holdout loses: no label, a blank one, or one that ``sites`` does not list."""
    reason = F.when(F.col(site).isNull(), "missing").when(F.trim(site) == "", "blank")
    if sites is not None:
        reason = reason.when(~F.col(site).isin(*sites), "unlisted")
    return df.select(row_id, reason.alias("reason")).where(F.col("reason").isNotNull())
