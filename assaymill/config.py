"""Every threshold the operators use, in one typed place.

Operators take an ``AuditConfig`` (or a keyword with the same default) and never
spell a number themselves, so the same job runs on any numeric truth/prediction
pair.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: these must equal the published definitions -----------------
BIN_EDGES = (4.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 18.0)
Z_LIMITS = 1.96
Z_INTERVAL = 1.959963984540054
SEVERITY_CLASSES = ("normal", "mild", "moderate", "severe")
CONFOUND_NOTE = (
    "Site is confounded with lighting: every site contrast is also a contrast "
    "between two lighting setups."
)
NO_PROBABILITY = "no confidence column, so there is no probability to calibrate"
# ------------------------------------------------------------------------------

BIN_CENTRES = tuple((lo + hi) / 2.0 for lo, hi in zip(BIN_EDGES, BIN_EDGES[1:]))


@dataclass(frozen=True)
class AuditConfig:
    # screening cut-offs
    cut_male: float = 13.0
    cut_other: float = 12.0
    cut_moderate: float = 9.0
    cut_severe: float = 7.0
    # accepted label range
    label_min: float = 3.0
    label_max: float = 25.0
    # randomness
    seed: int = 42
    # power floors and effect sizes
    min_n: int = 20
    min_abs_slope: float = 0.002
    subgroup_min_n: int = 5
    near_tie: float = 0.10
    agreement_margin: float = 1.0
    # probability scale
    centres: tuple[float, ...] = BIN_CENTRES
    soft_sigma: float = 0.6
    calibration_bins: int = 10
    # fitting of heads
    fit_iterations: int = 100
    fit_tolerance: float = 1e-9
    regularisations: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0)
    # image quality gate
    dark_luma: float = 40.0
    bright_luma: float = 235.0
    clipped_fraction: float = 0.02
    blur_variance: float = 40.0
    roi_min_area: float = 0.015
    roi_max_area: float = 0.85
    quality_abstain: float = 0.60
    quality_candidates: tuple[float, ...] = (0.35, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
    # event intake
    rate_limit: int = 30
    rate_window_ms: int = 60_000
    telemetry_daily_cap: int = 20_000
    feedback_daily_cap: int = 5_000
    max_body_bytes: int = 1024


DEFAULTS = AuditConfig()
