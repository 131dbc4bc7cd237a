"""Image quality score, verdict and message from measured columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS

# fixed values: score weights and scales, verdict codes
WEIGHTS = (0.4, 0.4, 0.2)
MID_LUMA = 130.0
SHARP_SCALE = 400.0
FULL_FRAMING = 0.10
MESSAGES = {
    "DECODE_FAIL": "This file holds no picture that can be opened.",
    "TOO_DARK": "Not enough light: take it again near a window.",
    "TOO_BRIGHT": "Too much light: turn off the flash or step out of the sun.",
    "TOO_BLUR": "Out of focus: rest your hand and let the camera settle first.",
    "WRONG_FRAMING": "The eyelid is too small, or cut off: bring it to the middle of the picture.",
}
# ------------------------------------------------------------------------------


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def score(luma: Column, sharpness: Column, roi_area: Column) -> Column:
    exposure = _unit(1.0 - F.abs(luma - MID_LUMA) / MID_LUMA)
    focus = _unit(F.log1p(sharpness) / math.log1p(SHARP_SCALE))
    framing = F.when(roi_area.isNull(), 1.0).otherwise(_unit(roi_area / FULL_FRAMING))
    return WEIGHTS[0] * exposure + WEIGHTS[1] * focus + WEIGHTS[2] * framing


def reason(
    luma: Column, clipped: Column, sharpness: Column, roi_area: Column, decoded: Column, cfg: AuditConfig = DEFAULTS
) -> Column:
    """The first problem in the order a person would fix them; NULL passes."""
    return (
        F.when(~F.coalesce(decoded, F.lit(False)), "DECODE_FAIL")
        .when(luma < cfg.dark_luma, "TOO_DARK")
        .when((luma > cfg.bright_luma) | (clipped > cfg.clipped_fraction), "TOO_BRIGHT")
        .when(sharpness < cfg.blur_variance, "TOO_BLUR")
        .when((roi_area < cfg.roi_min_area) | (roi_area > cfg.roi_max_area), "WRONG_FRAMING")
    )


def message(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return F.try_element_at(table, code)
