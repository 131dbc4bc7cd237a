"""Validation suite: every check is one row (label, passed, severity, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.operators.corpus import band_histogram, mask_of


def level(passed: Column, severity: Column) -> Column:
    """A failed check is a failure, whatever severity it declares."""
    return F.when(~passed, "FAIL").otherwise(severity)


def check(label: str | Column, passed: Column, detail: Column, severity: Column | str = "OK") -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    grade = F.lit(severity) if isinstance(severity, str) else severity
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(
        name.alias("label"), ok.alias("passed"), level(ok, grade).alias("severity"), detail.cast("string").alias("detail")
    )


def as_rows(facts: DataFrame, checks: Sequence[Column]) -> DataFrame:
    return facts.select(F.inline(F.array(*checks)))


def contract_checks(
    records: DataFrame,
    counts: Mapping[str, int],
    means: Mapping[str, float],
    withdrawn: str,
    roi: str,
    tolerance: float = 0.02,
) -> DataFrame:
    """Is this the corpus it claims to be? One aggregation answers all."""
    v, site, pid = F.col("value"), F.col("site"), F.col("patient_id")
    ids = records.groupBy("patient_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).scalar()
    facts = records.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(site == s).alias(f"n_{i}") for i, s in enumerate(counts)],
        *[F.avg(F.when(site == s, v)).alias(f"m_{i}") for i, s in enumerate(means)],
        F.count_if(pid == withdrawn).alias("gone"),
        F.count_if(~F.contains(pid, F.lit("/"))).alias("bare"),
        F.count_if(mask_of(F.col("masks"), roi).isNull()).alias("unmasked"),
    ).withColumn("most", ids)
    total = sum(counts.values())
    rows = [check(f"all {total} records load", F.col("n") == total, F.col("n"))]
    rows += [
        check(f"{s} holds {c} records", F.col(f"n_{i}") == c, F.col(f"n_{i}")) for i, (s, c) in enumerate(counts.items())
    ]
    rows += [
        check(f"mean of {s} is {m}", F.abs(F.col(f"m_{i}") - m) < tolerance, F.round(f"m_{i}", 3))
        for i, (s, m) in enumerate(means.items())
    ]
    rows += [
        check(f"{withdrawn} is withdrawn", F.col("gone") == 0, F.col("gone")),
        check("ids are unique", F.col("most") <= 1, F.col("most")),
        check("ids are site-qualified", F.col("bare") == 0, F.col("bare")),
        check(f"every record has region {roi}", F.col("unmasked") == 0, F.col("unmasked")),
    ]
    return as_rows(facts, rows)


def domain_checks(records: DataFrame, sites: Sequence[str], cfg: AuditConfig = DEFAULTS) -> DataFrame:
    v = F.col("value")
    facts = records.agg(
        F.count_if(~v.between(cfg.label_min, cfg.label_max)).alias("outside"),
        F.count_if(~F.col("sex").isin("F", "M")).alias("odd_sex"),
        F.count_if(~F.col("site").isin(*sites)).alias("odd_site"),
    )
    return as_rows(
        facts,
        [
            check(
                f"every value lies in [{cfg.label_min:g}, {cfg.label_max:g}]", F.col("outside") == 0, F.col("outside")
            ),
            check(
                "sex has a severity definition",
                F.lit(True),
                F.col("odd_sex"),
                F.when(F.col("odd_sex") > 0, "WARN").otherwise("OK"),
            ),
            check("site is known", F.col("odd_site") == 0, F.col("odd_site")),
        ],
    )


def band_checks(records: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Share of each band; an empty band limits the conclusions."""
    hist = band_histogram(records, cfg)
    return hist.select(
        F.inline(
            F.array(
                check(
                    F.concat(F.lit("severity band "), F.col("band")),
                    F.lit(True),
                    F.concat(F.col("n").cast("string"), F.lit(" records")),
                    F.when(F.col("n") == 0, "WARN").otherwise("OK"),
                )
            )
        )
    )


def holdout_checks(sizes: DataFrame) -> DataFrame:
    """Every direction (fold, n_test) must evaluate somebody; one row each."""
    label = F.concat(F.lit("holdout "), F.col("fold"), F.lit(" evaluates records"))
    return sizes.select(F.inline(F.array(check(label, F.col("n_test") > 0, F.col("n_test")))))


def duplicate_checks(labels: DataFrame) -> DataFrame:
    """Rows of a sheet that share a number: the last one is used."""
    copies = labels.groupBy("site", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    facts = copies.agg(F.count(F.lit(1)).alias("k"))
    return as_rows(
        facts,
        [check("no number is used twice", F.lit(True), F.col("k"), F.when(F.col("k") > 0, "WARN").otherwise("OK"))],
    )


def suite(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def status(checks: DataFrame) -> DataFrame:
    s = F.col("severity")
    return checks.agg(
        (F.count_if(s == "FAIL") == 0).alias("passed"),
        F.count_if(s == "FAIL").alias("n_fail"),
        F.count_if(s == "WARN").alias("n_warn"),
        F.count_if(s == "OK").alias("n_ok"),
    )
