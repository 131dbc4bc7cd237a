"""Colour expressions on 8-bit sRGB, integer and floating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sRGB (IEC 61966-2-1) to CIE XYZ under D65, the white point, and
# the CIELAB breakpoints (CIE 15:2004)
RGB_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
WHITE = (0.95047, 1.0, 1.08883)
EPSILON = 216.0 / 24389.0
KAPPA = 24389.0 / 27.0
LUMA = (0.2126, 0.7152, 0.0722)
# fixed-point grey weights of 8-bit images, in units of 2**-15
GREY = (9798, 19235, 3735)
GREY_SHIFT = 15
HSV_SHIFT = 12
# ------------------------------------------------------------------------------

MIN_CHROMA = 1e-9


def linear(channel: Column, peak: Column | float = 255.0) -> Column:
    c = channel / peak
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def detected_peak(largest: Column) -> Column:
    """Full scale of a float image, read from its largest value."""
    return F.when(largest > 1.5, 255.0).otherwise(1.0)


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", peak: Column | float = 255.0) -> DataFrame:
    """Add CIELAB columns ``lab_l``, ``lab_a``, ``lab_b``."""
    df = df.withColumns({f"_{c}": linear(F.col(n), peak) for c, n in zip("rgb", (r, g, b))})
    xyz = {}
    for axis, row, white in zip("xyz", RGB_TO_XYZ, WHITE):
        xyz[f"_{axis}"] = (F.lit(row[0]) * F.col("_r") + F.lit(row[1]) * F.col("_g") + F.lit(row[2]) * F.col("_b")) / white
    df = df.withColumns(xyz)
    df = df.withColumns(
        {
            f"_f{a}": F.when(F.col(f"_{a}") > EPSILON, F.cbrt(f"_{a}")).otherwise((KAPPA * F.col(f"_{a}") + 16.0) / 116.0)
            for a in "xyz"
        }
    )
    df = df.withColumns(
        {
            "lab_l": 116.0 * F.col("_fy") - 16.0,
            "lab_a": 500.0 * (F.col("_fx") - F.col("_fy")),
            "lab_b": 200.0 * (F.col("_fy") - F.col("_fz")),
        }
    )
    return df.drop(*[f"_{c}" for c in ("r", "g", "b", "x", "y", "z", "fx", "fy", "fz")])


def redness(a: Column, b: Column) -> Column:
    chroma = F.hypot(a, b)
    return F.when(chroma >= MIN_CHROMA, a / chroma)


def erythema(a: Column, b: Column) -> Column:
    ratio = redness(a, b)
    return F.when(ratio > 0, 100.0 * F.log10(1.0 / ratio))


def with_hsv(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Add 8-bit ``hsv_h`` in [0, 180), ``hsv_s``, ``hsv_v`` by fixed-point steps."""
    red, green, blue = F.col(r), F.col(g), F.col(b)
    df = df.withColumn("hsv_v", F.greatest(red, green, blue).cast("int"))
    df = df.withColumn("_d", (F.col("hsv_v") - F.least(red, green, blue)).cast("int"))
    v, d = F.col("hsv_v"), F.col("_d")
    half = 1 << (HSV_SHIFT - 1)
    s_scale = F.when(v > 0, F.rint(F.lit(float(255 << HSV_SHIFT)) / v)).otherwise(0).cast("int")
    h_scale = F.when(d > 0, F.rint(F.lit(float(180 << HSV_SHIFT)) / (6.0 * d))).otherwise(0).cast("int")
    sector = F.when(v == red, green - blue).when(v == green, blue - red + 2 * d).otherwise(red - green + 4 * d)
    hue = F.shiftright(sector.cast("int") * h_scale + half, HSV_SHIFT)
    df = df.withColumns({"hsv_s": F.shiftright(d * s_scale + half, HSV_SHIFT), "_h": hue})
    return df.withColumn("hsv_h", F.when(F.col("_h") < 0, F.col("_h") + 180).otherwise(F.col("_h"))).drop("_d", "_h")


def grey(r: Column, g: Column, b: Column) -> Column:
    weighted = r.cast("int") * GREY[0] + g.cast("int") * GREY[1] + b.cast("int") * GREY[2]
    return F.shiftright(weighted + (1 << (GREY_SHIFT - 1)), GREY_SHIFT)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(LUMA[0]) * r + F.lit(LUMA[1]) * g + F.lit(LUMA[2]) * b


def stressed(r: Column, g: Column, b: Column, exposure: float, warmth: float) -> dict[str, Column]:
    """Exposure and white-balance shift, clipped to 8 bit."""

    def clip(c: Column) -> Column:
        return F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c))).cast("int")

    factor = 1.0 + exposure
    return {"r": clip(r * factor + warmth), "g": clip(g * factor), "b": clip(b * factor - warmth)}


def masked(channel: Column, in_roi: Column) -> Column:
    return F.when(in_roi, channel).otherwise(0)
