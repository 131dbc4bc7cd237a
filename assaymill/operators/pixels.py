"""Colour and quality measurement over pixel tables.

A pixel table has ``image_id, r, g, b, in_roi`` and, where position matters,
``x, y``. ``in_roi`` is NULL on every pixel of an image without a mask: such an
image is measured whole and flagged. Colour statistics need only the counts per
distinct colour, so the first step reduces pixels to counts on the map side; all
later groups hold at most 256 values per image and channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.functions import colour, quality
from assaymill.session import written

ID = "image_id"
MIN_PERCENTILE_PIXELS = 100
ROWS_PER_TASK = 1_000_000
FLT_EPSILON = 1.1920929e-07
DBL_EPSILON = 2.220446049250313e-16
BALANCE_EPS = 1e-6
FEATURES = (
    "lab_l", "lab_a", "lab_b", "redness_ratio", "erythema_index", "high_hue_ratio", "otsu_vessel_redness",
    "hsv_hue", "hsv_sat", "hsv_val", "roi_r", "roi_g", "roi_b",
)
UNDEFINED = ("erythema_index",)


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` to as many tasks as its rows ask for, where the session's number is too few."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(tasks, *columns) if tasks > least else df


def colour_counts(pixels: DataFrame) -> DataFrame:
    colours = [ID, "r", "g", "b", "in_roi"]
    return _spread(pixels, *colours).groupBy(*colours).agg(F.count(F.lit(1)).alias("n"))


def _inside() -> Column:
    return F.coalesce(F.col("in_roi"), F.lit(True))


def _roi_n() -> Column:
    return F.when(_inside(), F.col("n"))


def _roi_mean(value: str) -> Column:
    return F.try_divide(F.sum(_roi_n() * F.col(value)), F.sum(_roi_n()))


def mean_lab(counts: DataFrame) -> DataFrame:
    """Mean CIELAB inside the region; NULL, not absent, when it is empty."""
    return colour.with_lab(counts).groupBy(ID).agg(
        F.coalesce(F.sum(_roi_n()), F.lit(0)).alias("n_roi"), *[_roi_mean(c).alias(c) for c in ("lab_l", "lab_a", "lab_b")]
    )


def high_hue_ratio(counts: DataFrame) -> DataFrame:
    """Bright over dark channel value, at the 99th and 1st percentile.

    Below 100 pixels the extremes are used; a black dark end gives NULL.
    """
    long = counts.where(_inside()).select(ID, "n", F.explode(F.array("r", "g", "b")).alias("v"))
    per_value = long.groupBy(ID, "v").agg(F.sum("n").alias("n"))
    agg = per_value.groupBy(ID).agg(
        (F.sum("n") / 3).alias("px"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.percentile("v", F.array(F.lit(0.01), F.lit(0.99)), F.col("n")).alias("q"),
    )
    many = F.col("px") >= MIN_PERCENTILE_PIXELS
    lo = F.when(many, F.col("q")[0]).otherwise(F.col("lo").cast("double"))
    hi = F.when(many, F.col("q")[1]).otherwise(F.col("hi").cast("double"))
    return agg.select(ID, F.when(lo >= 1.0, hi / lo).alias("high_hue_ratio"))


def vessel_contrast(counts: DataFrame) -> DataFrame:
    """Mean a* above minus below the Otsu threshold of the whole frame.

    a* is scaled to 8 bit between its extremes; the histogram has at most 256
    rows per image, so its windows are small whatever the image size.
    """
    lab = (counts if "lab_a" in counts.columns else colour.with_lab(counts)).select(ID, "lab_a", "n")
    ends = lab.groupBy(ID).agg(F.min("lab_a").alias("lo"), F.max("lab_a").alias("hi"))
    span = F.col("hi") - F.col("lo")
    ends = ends.withColumn("scale", F.when(span > DBL_EPSILON, 255.0 * (1.0 / span)).otherwise(0.0))
    ends = ends.select(ID, "scale", (-F.col("lo") * F.col("scale")).alias("shift"))
    level = F.floor(F.col("lab_a") * F.col("scale") + F.col("shift")).cast("int")
    hist = (
        lab.join(ends, ID)
        .groupBy(ID, F.least(F.lit(255), F.greatest(F.lit(0), level)).alias("bin"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("lab_a")).alias("sa"))
    )
    every = Window.partitionBy(ID)
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumns(
        {
            "cn": F.sum("n").over(upto),
            "cm": F.sum(F.col("n") * F.col("bin")).over(upto),
            "tn": F.sum("n").over(every),
            "tm": F.sum(F.col("n") * F.col("bin")).over(every),
        }
    )
    q1 = F.col("cn") / F.col("tn")
    q2 = 1.0 - q1
    usable = (F.least(q1, q2) >= FLT_EPSILON) & (F.greatest(q1, q2) <= 1.0 - FLT_EPSILON)
    gap = F.col("cm") / F.col("cn") - F.try_divide(F.col("tm") - F.col("cm"), F.col("tn") - F.col("cn"))
    hist = hist.withColumn("sigma", F.when(usable, q1 * q2 * gap * gap))
    cut = F.coalesce(F.max_by("bin", F.when(F.col("sigma") > 0, F.struct("sigma", -F.col("bin")))).over(every), F.lit(0))
    hist = hist.withColumn("above", F.col("bin") > cut)
    hi, lo = F.col("above"), ~F.col("above")

    def mean(part: Column) -> Column:
        return F.try_divide(F.sum(F.when(part, F.col("sa"))), F.sum(F.when(part, F.col("n"))))

    return hist.groupBy(ID).agg((mean(hi) - mean(lo)).alias("otsu_vessel_redness"))


def colour_features(counts: DataFrame) -> DataFrame:
    """The measured vector per image, with the region's mean RGB and the flag.

    The counts go to their images once, with Lab and HSV; every group below reads
    the written rows.
    """
    both = written(colour.with_hsv(colour.with_lab(counts.repartition(ID))))
    half = F.lit(0.5)
    base = both.groupBy(ID).agg(
        *[_roi_mean(c).alias(c) for c in ("lab_l", "lab_a", "lab_b")],
        *[F.percentile(s, half, _roi_n()).alias(o) for s, o in (("hsv_h", "hsv_hue"), ("hsv_s", "hsv_sat"), ("hsv_v", "hsv_val"))],
        *[(_roi_mean(c) / 255.0).alias(f"roi_{c}") for c in "rgb"],
        F.bool_and(F.col("in_roi").isNull()).alias("unmasked"),
    )
    a, b = F.col("lab_a"), F.col("lab_b")
    base = base.withColumns({"redness_ratio": colour.redness(a, b), "erythema_index": colour.erythema(a, b)})
    out = base.join(high_hue_ratio(both), ID, "left").join(vessel_contrast(both), ID, "left")
    return out.select(ID, *FEATURES, "unmasked")


def illuminant(counts: DataFrame, method: str = "grey_world") -> DataFrame:
    """Reference colour outside the region (or of the frame) and the brightness scalar."""
    outside = F.when(F.col("in_roi") == F.lit(False), F.col("n"))
    means = counts.groupBy(ID).agg(
        *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"m_{c}") for c in "rgb"],
        *[F.try_divide(F.sum(outside * F.col(c)), F.sum(outside)).alias(f"o_{c}") for c in "rgb"],
    )
    if method == "grey_world":
        lights = {f"i_{c}": F.coalesce(f"o_{c}", f"m_{c}") for c in "rgb"}
        found = means.withColumns(lights)
    elif method == "white_patch":
        light = colour.luma(F.col("r"), F.col("g"), F.col("b"))
        out = F.col("in_roi") == F.lit(False)
        tops = counts.groupBy(ID).agg(F.max(F.when(out, light)).alias("t_out"), F.max(light).alias("t_all"))
        lit = counts.join(tops, ID).withColumn("_l", light)
        keep = (F.coalesce(out, F.lit(False)) | F.col("t_out").isNull()) & (
            F.col("_l") >= 0.99 * F.coalesce("t_out", "t_all")
        )
        peaks = lit.groupBy(ID).agg(*[F.max(F.when(keep, F.col(c))).cast("double").alias(f"i_{c}") for c in "rgb"])
        found = means.join(peaks, ID)
    else:
        raise ValueError(f"unknown method {method!r}")
    found = found.withColumns({f"i_{c}": F.when(F.col(f"i_{c}") > BALANCE_EPS, F.col(f"i_{c}")).otherwise(1.0) for c in "rgb"})
    before = sum((F.col(f"m_{c}") for c in "rgb"), F.lit(0.0)) / 3.0 / 255.0
    after = sum((F.col(f"m_{c}") / F.col(f"i_{c}") for c in "rgb"), F.lit(0.0)) / 3.0 / 255.0
    found = found.withColumns({"_b": before, "_a": after})
    scale = F.when(F.col("_a") > BALANCE_EPS, F.col("_b") / F.col("_a")).otherwise(1.0)
    return found.select(ID, "i_r", "i_g", "i_b", scale.alias("scale"))


def balanced(counts: DataFrame, method: str = "grey_world") -> DataFrame:
    """Counts with the illuminant divided out, clipped and rounded half to even."""
    # Written, as the lights and the pixels both read them.
    counts = _spread(written(counts), ID)
    lit = counts.join(illuminant(counts, method), ID)

    def fixed(c: str) -> Column:
        unit = F.col(c) / 255.0 / F.col(f"i_{c}") * F.col("scale")
        return F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit)) * 255.0).cast("int")

    moved = lit.select(ID, "in_roi", "n", *[fixed(c).alias(c) for c in "rgb"])
    return moved.groupBy(ID, "r", "g", "b", "in_roi").agg(F.sum("n").alias("n"))


def balanced_features(counts: DataFrame, method: str = "grey_world") -> DataFrame:
    """Features of the balanced image; the region means stay those of the original."""
    raw = counts.groupBy(ID).agg(*[(_roi_mean(c) / 255.0).alias(f"roi_{c}") for c in "rgb"])
    out = colour_features(balanced(counts, method)).drop("roi_r", "roi_g", "roi_b").join(raw, ID)
    return out.select(ID, *FEATURES, "unmasked")


def laplacian(pixels: DataFrame, value: str) -> DataFrame:
    """Four-neighbour Laplacian with mirrored borders, per pixel.

    Windows run along one image row and one image column, so their size is the
    side of an image.
    """
    v = F.col(value)
    row = Window.partitionBy(ID, "y").orderBy("x")
    column = Window.partitionBy(ID, "x").orderBy("y")
    sides = {}
    for name, w in (("h", row), ("v", column)):
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        sides[f"_{name}"] = F.coalesce(before, after, v) + F.coalesce(after, before, v)
    return pixels.withColumns(sides).withColumn("laplacian", F.col("_h") + F.col("_v") - 4 * v).drop("_h", "_v")


def quality_measures(pixels: DataFrame) -> DataFrame:
    """Mean grey, clipped share, focus measure and region share per image."""
    grey = pixels.withColumn("grey", colour.grey(F.col("r"), F.col("g"), F.col("b")))
    return laplacian(grey, "grey").groupBy(ID).agg(
        F.avg("grey").alias("luma"),
        F.avg((F.col("grey") >= 255).cast("double")).alias("clipped"),
        F.var_pop("laplacian").alias("sharpness"),
        F.avg(F.col("in_roi").cast("double")).alias("roi_area"),
        (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"),
    )


def quality_report(measures: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Score, verdict code and message; an undecodable image has height below one."""
    luma, clip, sharp, area = (F.col(c) for c in ("luma", "clipped", "sharpness", "roi_area"))
    decoded = F.col("height") > 0
    out = measures.withColumn("reason", quality.reason(luma, clip, sharp, area, decoded, cfg))
    return out.withColumns(
        {
            "score": F.when(decoded, quality.score(luma, sharp, area)).otherwise(0.0),
            "passed": F.col("reason").isNull(),
            "message": quality.message(F.col("reason")),
        }
    )


def threshold_sweep(report: DataFrame, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """How many passing images each candidate threshold would refuse."""
    cuts = cfg.quality_candidates
    wide = report.where("passed").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("score") < t).alias(f"k{i}") for i, t in enumerate(cuts)]
    )
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("abstain"), F.col("n")) for i, t in enumerate(cuts)]
    return wide.select(F.inline(F.array(*rows))).withColumns(
        {
            "share": F.coalesce(F.try_divide("abstain", "n"), F.lit(0.0)),
            "live": F.col("threshold") == cfg.quality_abstain,
            "inert": F.col("abstain") == 0,
        }
    )


def reason_counts(report: DataFrame) -> DataFrame:
    return report.where(~F.col("passed")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def resolutions(frames: DataFrame) -> DataFrame:
    """Sizes in use; the most common one is marked."""
    counts = frames.where("height > 0").groupBy("height", "width").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max(F.struct("n", "height", "width"))).scalar()
    return counts.withColumn("most_common", F.struct("n", "height", "width") == top)


def bounding_box(pixels: DataFrame) -> DataFrame:
    """Box of the region with a margin, inside the frame; NULL for an empty region."""
    inside = F.col("in_roi")

    def end(f, c: str) -> Column:
        return f(F.when(inside, F.col(c)))

    box = pixels.groupBy(ID).agg(
        end(F.min, "x").alias("x0"),
        (end(F.max, "x") + 1).alias("x1"),
        end(F.min, "y").alias("y0"),
        (end(F.max, "y") + 1).alias("y1"),
        (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"),
    )
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = box.withColumn("pad", F.greatest(F.lit(2), F.floor(0.10 * side).cast("int")))
    return box.select(
        ID,
        "width",
        "height",
        F.when(F.col("x0").isNotNull(), F.greatest(F.lit(0), F.col("x0") - F.col("pad"))).alias("x0"),
        F.when(F.col("x0").isNotNull(), F.least(F.col("width"), F.col("x1") + F.col("pad"))).alias("x1"),
        F.when(F.col("x0").isNotNull(), F.greatest(F.lit(0), F.col("y0") - F.col("pad"))).alias("y0"),
        F.when(F.col("x0").isNotNull(), F.least(F.col("height"), F.col("y1") + F.col("pad"))).alias("y1"),
    )


def measured_panel(pixels: DataFrame) -> DataFrame:
    """Mean colour of the crop around the region."""
    box = bounding_box(pixels).select(ID, "x0", "x1", "y0", "y1")
    x, y = F.col("x"), F.col("y")
    crop = pixels.join(box, ID).where((x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1")))
    means = colour.with_lab(crop).groupBy(ID).agg(
        *[F.floor(F.avg(c) + 0.5).alias(f"mean_{c}") for c in "rgb"],
        *[F.avg(c).alias(c) for c in ("lab_l", "lab_a", "lab_b")],
    )
    a, b = F.col("lab_a"), F.col("lab_b")
    return means.withColumns({"erythema_index": colour.erythema(a, b), "redness_ratio": colour.redness(a, b)})


def mask_on_frame(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Nearest-neighbour mask value for every frame pixel.

    ``masks`` has ``image_id, mx, my, mask_on`` at its own resolution. A frame
    without a mask keeps NULL.
    """
    frame = pixels.groupBy(ID).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    mask = masks.groupBy(ID).agg((F.max("mx") + 1).alias("_mw"), (F.max("my") + 1).alias("_mh"))
    placed = pixels.drop("in_roi").join(frame.join(mask, ID, "left"), ID)
    placed = placed.withColumns(
        {
            "mx": F.floor(F.col("x") * F.col("_mw") / F.col("_w")).cast("int"),
            "my": F.floor(F.col("y") * F.col("_mh") / F.col("_h")).cast("int"),
        }
    )
    out = placed.join(masks, [ID, "mx", "my"], "left").withColumnRenamed("mask_on", "in_roi")
    return out.drop("mx", "my", "_w", "_h", "_mw", "_mh")


def geometry(frames: DataFrame, masks: DataFrame, tolerance: float = 0.02, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Per patient and region: area share, and what is wrong with the pair.

    ``frames`` has ``patient_id, height, width``; ``masks`` adds ``roi, area``
    (share of mask pixels) with its own size, height below one when unreadable.
    """
    f = frames.select("patient_id", F.col("height").alias("fh"), F.col("width").alias("fw"))
    m = masks.select("patient_id", "roi", "area", F.col("height").alias("mh"), F.col("width").alias("mw"))
    ratio = (F.col("mw") / F.col("mh")) / (F.col("fw") / F.col("fh"))
    problem = (
        F.when(F.col("mh") < 1, "uncroppable")
        .when(F.abs(ratio - 1.0) > tolerance, "misaligned")
        .when(F.col("area") == 0, "uncroppable")
        .when(~F.col("area").between(cfg.roi_min_area, cfg.roi_max_area), "area")
    )
    return m.join(f, "patient_id").withColumn("problem", problem)
