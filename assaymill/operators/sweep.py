"""Configuration candidates: grid, validity, filter, ranking and choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaymill.config import DEFAULTS
from assaymill.functions.names import ROIS, cache_key, candidate_label

# fixed values: the three dimensions of a candidate
KINDS = ("deep", "colour", "hybrid")
BALANCES = ("balanced", "raw")
LOWER_IS_BETTER = {"mae": True, "r2": False}
# ------------------------------------------------------------------------------


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def invalid_reason() -> Column:
    kind, roi, balance = F.col("kind"), F.col("roi"), F.col("balance")
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown kind")
        .when(~F.coalesce(roi.isin(*ROIS), F.lit(False)), "unknown roi")
        .when(~F.coalesce(balance.isin(*BALANCES), F.lit(False)), "unknown balance")
        .when((kind == "deep") & (balance != "balanced"), "deep has no balance")
    )


def labelled(candidates: DataFrame) -> DataFrame:
    k, r, b = F.col("kind"), F.col("roi"), F.col("balance")
    return candidates.withColumns({"label": candidate_label(k, r, b), "cache_key": cache_key(k, r, b)})


def grid(spark: SparkSession, head: str = "regression") -> DataFrame:
    """Every valid combination: three regions times deep and two kinds in two balances."""
    one = spark.range(1).select(F.lit(head).alias("head"), F.explode(_literals(ROIS)).alias("roi"))
    two = one.withColumn("kind", F.explode(_literals(KINDS)))
    three = two.withColumn("balance", F.explode(_literals(BALANCES)))
    return labelled(three.where(invalid_reason().isNull()))


def validated(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = candidates.withColumn("reason", invalid_reason())
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def extraction_keys(candidates: DataFrame) -> DataFrame:
    """Heads share features: one extraction per kind, region and balance."""
    return labelled(candidates).select("cache_key").distinct()


def spellings(candidates: DataFrame) -> DataFrame:
    ways = F.array_distinct(F.array("cache_key", F.concat_ws("/", "kind", "roi"), "label"))
    return labelled(candidates).withColumn("term", F.explode(ways))


def chosen(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates that any requested term names, in any of three spellings."""
    named = spellings(candidates).join(terms.select(F.trim("term").alias("term")), "term", "left_semi")
    return named.drop("term").dropDuplicates(["label", "head"] if "head" in candidates.columns else ["label"])


def unmatched_terms(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that name no candidate; one is enough to refuse the request."""
    wanted = terms.select(F.trim("term").alias("term")).where("term <> ''").distinct()
    return wanted.join(spellings(candidates), "term", "left_anti")


def ranked(rows: DataFrame, metric: str = "mae", by: Sequence[str] = ()) -> DataFrame:
    """Best first; a score that is not finite loses; ties go by label ascending.

    The table holds one row per candidate, so a plain window is enough.
    """
    score = F.col(f"val_{metric}")
    finite = F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score)
    key = F.asc_nulls_last("_score") if LOWER_IS_BETTER[metric] else F.desc_nulls_last("_score")
    w = Window.partitionBy(*by).orderBy(key, "label")
    out = rows.withColumn("_score", finite).withColumns(
        {"rank": F.row_number().over(w), "_next": F.lead("_score").over(w)}
    )
    win = (F.col("rank") == 1) & F.col("_score").isNotNull()
    return out.withColumns({"selected": win, "gap": F.when(win, F.abs(F.col("_next") - F.col("_score")))}).drop("_score", "_next")


def winner(rows: DataFrame, metric: str = "mae", by: Sequence[str] = (), near_tie: float = DEFAULTS.near_tie) -> DataFrame:
    """The selected candidate, its lead over the next, and whether that is a near tie."""
    best = ranked(rows, metric, by).where("selected")
    return best.withColumn("near_tie", F.coalesce(F.col("gap") < near_tie, F.lit(False)))


def report(rows: DataFrame, metric: str = "mae") -> DataFrame:
    """One row per candidate, best first, rounded; never one per patient."""
    keep = [c for c in ("label", "kind", "roi", "balance", "head", "feature_dim", "val_mae", "val_r2", "n_unmasked") if c in rows.columns]
    out = ranked(rows, metric)
    rounded = {c: F.round(c, 4) for c in ("val_mae", "val_r2") if c in keep}
    return out.select(*keep, "rank", "selected").withColumns(rounded).orderBy("rank")


def same_features(prints: DataFrame) -> DataFrame:
    """Candidates whose feature tables have equal fingerprints: read twice?"""
    pairs = prints.groupBy("n", "xor", "sum").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return pairs.where(F.size("labels") > 1).select("labels", "n")
