"""Report tables: nested results, flat views of them, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.functions.who import client_band
from assaymill.operators.events import iso_timestamp

# fixed values: heads lead in this order, others follow
HEAD_ORDER = ("ordinal", "regression", "severity", "multitask", "binary")


def head_rank(head: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(h) for h in HEAD_ORDER]), head)
    return F.when(at > 0, at - 1).otherwise(len(HEAD_ORDER)).cast("int")


def screening_log(df: DataFrame) -> DataFrame:
    """Export of field screenings, every number with two decimals."""

    def two(c: str) -> Column:
        return F.format_string("%.2f", c)

    missing = F.col("hb_hat").isNull()
    return df.select(
        "patient_id",
        iso_timestamp(F.col("ts")).alias("timestamp"),
        F.when(missing, "N/A").otherwise(two("hb_hat")).alias("hb_gdl"),
        F.when(missing, "abstain").otherwise(client_band(F.col("hb_hat"))).alias("who_band"),
        F.when(F.col("lo").isNull(), "").otherwise(two("lo")).alias("lo"),
        F.when(F.col("hi").isNull(), "").otherwise(two("hi")).alias("hi"),
        "status",
    )


# --- run facts ------------------------------------------------------------------


def with_manifest(df: DataFrame, settings: dict[str, object], corpus: str) -> DataFrame:
    """Columns that say where a result came from."""
    from assaymill.sources.feature_store import config_fingerprint

    return df.withColumns(
        {
            "fingerprint": F.lit(config_fingerprint(settings)),
            "corpus": F.lit(corpus),
            "generated_at": F.current_timestamp(),
        }
    )


# --- nested results report --------------------------------------------------------


def _listed(df: DataFrame, *first: str) -> Column:
    """All rows of a small table as one sorted array."""
    order = [*first, *[c for c in df.columns if c not in first]]
    return df.agg(F.array_sort(F.collect_list(F.struct(*order)))).scalar()


def results_report(
    heads: DataFrame,
    site_stats: DataFrame,
    site_audit: DataFrame,
    facts: dict[str, str],
    cfg: AuditConfig | None = None,
    holdout: DataFrame | None = None,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """One nested row: corpus, a list of head rows, and an audit map per head.

    Every input is an aggregate, one row per head, site, direction (``holdout``:
    fold, n_train, n_test) or head and target (``coverage``). With ``cfg`` the
    report holds its settings and the manifest columns.
    """
    corpus = site_stats.agg(
        F.sum("n").alias("n_patients"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", F.struct("n", "mean", "mean_age").alias("c"))))).alias("per_site"),
    )
    rows = heads.agg(F.array_sort(F.collect_list(F.struct("head", *[c for c in heads.columns if c != "head"]))).alias("rows"))
    per_site = site_audit.groupBy("head").agg(
        F.max(F.when(F.col("site") == "pooled", F.col("ece"))).alias("pooled_ece"),
        F.max("max_ece_gap").alias("max_ece_gap"),
        F.first("note").alias("confound"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("site") != "pooled", F.struct("site", F.struct("ece", "n").alias("c")))))
        ).alias("per_site"),
    )
    audit = per_site.agg(
        F.map_from_entries(
            F.collect_list(F.struct("head", F.struct("pooled_ece", "max_ece_gap", "confound", "per_site").alias("a")))
        ).alias("audit")
    )
    more = {}
    if holdout is not None:
        more["site_holdout"] = _listed(holdout, "fold")
    if coverage is not None:
        more["coverage"] = _listed(coverage, "head", "target")
    if cfg is not None:
        pairs = [x for k, v in settings_of(cfg).items() for x in (F.lit(k), F.lit(str(v)))]
        more["config"] = F.create_map(*pairs)
    report = corpus.select(
        F.struct(*[F.lit(v).alias(k) for k, v in facts.items()]).alias("provenance"),
        F.struct("n_patients", "per_site").alias("corpus"),
        rows.scalar().alias("single_split"),
        audit.scalar().alias("site_audit"),
        *[c.alias(k) for k, c in more.items()],
    )
    if cfg is None:
        return report
    # The manifest's corpus is its kind; the report has a section of that name.
    marked = with_manifest(report.withColumnRenamed("corpus", "_section"), settings_of(cfg), facts.get("corpus", "unknown"))
    return marked.withColumnsRenamed({"corpus": "corpus_kind", "_section": "corpus"})


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def report_heads(report: DataFrame) -> DataFrame:
    """Head rows in display order."""
    rows = report.select(F.inline("single_split"))
    return rows.withColumn("display", head_rank(F.col("head"))).orderBy("display", "head")


def report_site_ece(report: DataFrame) -> DataFrame:
    """Calibration per head and site, with the pooled figure and the widest gap."""
    per_head = report.select(F.explode("site_audit").alias("head", "a"))
    cells = per_head.select("head", "a.pooled_ece", "a.max_ece_gap", "a.confound", F.explode("a.per_site").alias("site", "c"))
    return cells.select("head", "site", "c.ece", "c.n", "pooled_ece", "max_ece_gap", "confound")


def report_sections(report: DataFrame) -> DataFrame:
    """Holdout sizes, coverage and numeric settings of a report, as (section, grp, metric, value)."""

    def cells(section: str, column: str, group: Column, metrics: tuple[str, ...]) -> DataFrame:
        rows = report.select(F.inline(column))
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return rows.select(F.lit(section).alias("section"), group.alias("grp"), F.inline(pairs))

    target = F.concat_ws("@", "head", F.format_string("%.1f", F.col("target")))
    settings = report.select(F.explode("config").alias("metric", "v")).select(
        F.lit("config").alias("section"), F.lit("").alias("grp"), "metric", F.col("v").try_cast("double").alias("value")
    )
    holdout = cells("site_holdout", "site_holdout", F.col("fold"), ("n_train", "n_test"))
    coverage = cells("coverage", "coverage", target, ("coverage", "mae"))
    return holdout.unionByName(coverage).unionByName(settings.where("value IS NOT NULL"))


def sweep_report(candidates: DataFrame, header: DataFrame) -> DataFrame:
    """Nested sweep report: header facts, the candidates and the winner."""
    rows = candidates.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in candidates.columns if c != "rank"]))).alias("c"))
    lead = candidates.where("selected").select("label").agg(F.first("label"))
    return header.select("*", rows.scalar().alias("candidates"), lead.scalar().alias("winner"))


def sweep_summary(report: DataFrame, near_tie: float = DEFAULTS.near_tie) -> DataFrame:
    """Candidates of a stored sweep, winner first, with the near-tie flag."""
    rows = report.select("winner", "selection_gap", F.inline("candidates"))
    picked = F.col("selected") | (F.col("label") == F.col("winner"))
    out = rows.withColumns(
        {"selected": picked, "near_tie": F.coalesce(F.col("selection_gap") < near_tie, F.lit(False))}
    )
    return out.orderBy(F.desc("selected"), F.asc_nulls_last("val_mae"), "label")


def text_table(df: DataFrame, digits: int = 2) -> DataFrame:
    """Numbers as printed in a table, a dash for what was not measured."""
    from pyspark.sql import types as T

    return df.select(
        *[
            F.coalesce(F.format_string(f"%.{digits}f", F.col(f.name)), F.lit("-")).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.coalesce(F.col(f.name).cast("string"), F.lit("-")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def settings_of(cfg: AuditConfig) -> dict[str, object]:
    from dataclasses import asdict

    return asdict(cfg)
