"""From label sheets and a file listing to patient records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.functions import names
from assaymill.functions.who import severity_band, sex_cutoff

DROP_ORDER = ("no label row", "excluded", "no value", "out of range", "no image", "no mask")
DEFAULT_ROI = "palpebral"


def typed_labels(raw: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Parse an all-text sheet; every text column is searched for a withdrawal."""
    text = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "string"]
    parsed = raw.withColumns({"_label": names.parse_label(F.col("hb")), "_out": names.withdrawn(text)})
    value = F.col("_label.value")
    return parsed.select(
        names.normal_site(F.col("site")).alias("site"),
        names.number_key(F.col("patient_id")).alias("number"),
        value.alias("value"),
        F.col("_label.reason").alias("reject_reason"),
        value.between(cfg.label_min, cfg.label_max).alias("in_range"),
        names.normal_sex(F.col("sex")).alias("sex"),
        names.age_value(F.col("age")).alias("age"),
        F.coalesce(F.trim("note"), F.lit("")).alias("note"),
        F.col("_out.marker").alias("marker"),
        F.col("_out.column").alias("marker_column"),
        "row_pos",
    )


def last_rows(labels: DataFrame) -> DataFrame:
    """One row per site and number: the last in the sheet wins; copies are counted."""
    keys = ("site", "number")
    rest = [c for c in labels.columns if c not in keys]
    out = labels.where(F.col("number").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "row_pos").alias("r"), F.count(F.lit(1)).alias("n_rows")
    )
    return out.select(*keys, "r.*", "n_rows")


def classified(files: DataFrame) -> DataFrame:
    """Each file with its region, if it is a mask, and whether it is an image."""
    name = F.col("name")
    png = names.suffix(name) == "png"
    roi = names.mask_roi(names.stem(name))
    out = files.withColumns({"is_image": names.is_image(name), "_roi": roi})
    return out.withColumns({"roi": F.when(png, F.col("_roi")), "is_photo": F.col("is_image") & F.col("_roi").isNull()}).drop("_roi")


def collapsed_masks(files: DataFrame) -> DataFrame:
    """One mask per folder and region, where copies of equal size count as one file.

    Masks are met in the order of their names. One of the size of the mask held so
    far is a copy, and the later name stays; of two different files the better
    ranked one stays. ``n_masks`` and ``n_copies`` say what was there. Each list holds
    the masks of one region of one folder.
    """
    masks = classified(files).where("roi IS NOT NULL").withColumn("_rank", names.mask_rank(F.col("name")))
    listed = masks.groupBy("site", "folder", "roi").agg(F.array_sort(F.collect_list(F.struct("name", "path", "length", "_rank"))).alias("_masks"))
    first = F.struct(F.element_at("_masks", 1).alias("m"), F.lit(0).alias("copies"))
    held = F.aggregate(
        F.slice("_masks", F.lit(2), F.size("_masks")),
        first,
        lambda acc, x: F.struct(
            F.when((x["length"] == acc["m"]["length"]) | (x["_rank"] < acc["m"]["_rank"]), x).otherwise(acc["m"]).alias("m"),
            (acc["copies"] + F.when(x["length"] == acc["m"]["length"], 1).otherwise(0)).alias("copies"),
        ),
    )
    return listed.withColumn("_held", held).select(
        "site", "folder", "roi", F.col("_held.m.path").alias("path"), F.col("_held.m.length").alias("length"), F.size("_masks").alias("n_masks"), F.col("_held.copies").alias("n_copies")
    )


def folders(files: DataFrame) -> DataFrame:
    """One row per patient folder: photograph and one mask per region.

    A single aggregation; folders without any image are skipped.
    """
    rank = names.mask_rank(F.col("name"))
    per_roi = [F.min_by("path", F.when(F.col("roi") == r, rank)).alias(f"mask_{r}") for r in names.ROIS]
    out = classified(files).groupBy("site", "folder").agg(
        F.bool_or("is_image").alias("_any"),
        F.min_by("path", F.when(F.col("is_photo"), F.col("name"))).alias("image"),
        F.count(F.lit(1)).alias("n_files"),
        *per_roi,
    )
    masks = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(r).alias("roi"), F.col(f"mask_{r}").alias("path")) for r in names.ROIS]),
            lambda e: e["path"].isNotNull(),
        )
    )
    return out.where("_any").withColumns({"masks": masks, "number": names.number_key(F.col("folder"))}).drop(
        "_any", *[f"mask_{r}" for r in names.ROIS]
    )


def mask_of(masks: Column, roi: str = DEFAULT_ROI) -> Column:
    return F.try_element_at(masks, F.lit(roi))


def matched(labels: DataFrame, folder_table: DataFrame) -> DataFrame:
    """Folders with their label row, if any."""
    sheet = last_rows(labels).withColumn("labelled", F.lit(True))
    return folder_table.join(sheet, ["site", "number"], "left")


def unmatched_labels(labels: DataFrame, folder_table: DataFrame) -> DataFrame:
    return last_rows(labels).join(folder_table, ["site", "number"], "left_anti")


def with_drop_reason(candidates: DataFrame, require_masks: bool = False) -> DataFrame:
    """The first rule a folder breaks, in fixed order; NULL keeps it."""
    tests = [
        F.col("labelled").isNull(),
        F.col("marker").isNotNull(),
        F.col("value").isNull(),
        ~F.col("in_range"),
        F.col("image").isNull(),
        mask_of(F.col("masks")).isNull() if require_masks else F.lit(False),
    ]
    reason = names.first_of([(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in zip(tests, DROP_ORDER)])
    return candidates.withColumns(
        {"patient_id": names.qualified(F.col("site"), F.col("folder")), "drop_reason": reason}
    )


def build_records(labels: DataFrame, files: DataFrame, require_masks: bool = False) -> DataFrame:
    """All folders with their drop reason; kept records have none."""
    return with_drop_reason(matched(labels, folders(files)), require_masks)


def kept(records: DataFrame) -> DataFrame:
    columns = ("patient_id", "site", "sex", "age", "value", "image", "masks", "note")
    return records.where(F.col("drop_reason").isNull()).select(*columns)


def corpus_order(records: DataFrame) -> DataFrame:
    return records.orderBy("site", names.local_number(F.col("patient_id")))


def drop_report(records: DataFrame) -> DataFrame:
    return records.groupBy("site", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def lacking_roi(records: DataFrame, roi: str) -> DataFrame:
    """Patients whose features would describe the whole frame."""
    return records.where(mask_of(F.col("masks"), roi).isNull()).select("patient_id", "site")


def site_stats(records: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Size, label distribution, age, prevalence and sex counts per site."""
    v = F.col("value")
    low = v < sex_cutoff(F.col("sex"), cfg)
    return records.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("lowest"),
        F.max(v).alias("highest"),
        F.avg("age").alias("mean_age"),
        (100.0 * F.avg(low.cast("double"))).alias("prevalence_pct"),
        F.count_if(F.col("sex") == "F").alias("n_f"),
        F.count_if(F.col("sex") == "M").alias("n_m"),
        F.count_if(F.col("sex") == "unknown").alias("n_unknown"),
    )


def band_histogram(records: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Counts and shares of all severity bands, the empty ones included."""
    from assaymill.config import SEVERITY_CLASSES

    band = severity_band(F.col("value"), F.col("sex"), cfg)
    wide = records.select(band.alias("b")).agg(
        F.count("b").alias("all"), *[F.count_if(F.col("b") == name).alias(name) for name in SEVERITY_CLASSES]
    )
    rows = [F.struct(F.lit(name).alias("band"), F.col(name).alias("n"), F.col("all")) for name in SEVERITY_CLASSES]
    long = wide.select(F.inline(F.array(*rows)))
    return long.select("band", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("all")), F.lit(0.0)).alias("share_pct"))


def corpus_kind(files: DataFrame, sites: tuple[str, ...] = names.SITES, marker: str = "SYNTHETIC_") -> DataFrame:
    """documented, synthetic or unknown, from the names alone."""
    top = F.substring_index("path", "/", 1)
    flags = files.agg(
        F.coalesce(F.bool_or(top.startswith(marker) | F.col("name").startswith(marker)), F.lit(False)).alias("fake"),
        *[F.coalesce(F.bool_or(top == s), F.lit(False)).alias(f"has_{s}") for s in sites],
    )
    both = F.col(f"has_{sites[0]}")
    for s in sites[1:]:
        both = both & F.col(f"has_{s}")
    return flags.select(F.when(F.col("fake"), "synthetic").when(both, "documented").otherwise("unknown").alias("kind"))
