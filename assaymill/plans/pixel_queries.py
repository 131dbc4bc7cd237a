"""Colour, illumination, quality and geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.functions import colour
from assaymill.operators import ordered as O
from assaymill.operators import pixels as X
from assaymill.plans.registry import published, query, r
from assaymill.plans.views import GRID, MASK_GRID, PIXELS, QUALITY

PX = f"(SELECT *, coalesce(in_roi, true) AS roi FROM ({PIXELS.sql()}))"
GR = f"({GRID.sql()})"
QU = f"({QUALITY.sql()})"


def _lin(c: str) -> str:
    return f"CASE WHEN {c}/255.0e0 <= 0.04045e0 THEN {c}/255.0e0/12.92e0 ELSE pow(({c}/255.0e0+0.055e0)/1.055e0, 2.4e0) END"


def lab_sql(source: str) -> str:
    f = "CASE WHEN {0} > 216.0e0/24389.0e0 THEN cbrt({0}) ELSE (24389.0e0/27.0e0*{0}+16)/116 END"
    return f"""(SELECT *, 116*fy-16 AS lab_l, 500*(fx-fy) AS lab_a, 200*(fy-fz) AS lab_b FROM (
     SELECT *, {f.format('cx')} AS fx, {f.format('cy')} AS fy, {f.format('cz')} AS fz FROM (SELECT *,
     (0.4124564e0*lr+0.3575761e0*lg+0.1804375e0*lb)/0.95047e0 AS cx, (0.2126729e0*lr+0.7151522e0*lg+0.0721750e0*lb) AS cy,
     (0.0193339e0*lr+0.1191920e0*lg+0.9503041e0*lb)/1.08883e0 AS cz FROM
     (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM {source}))))"""


def hsv_sql(source: str) -> str:
    return f"""(SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS hsv_h FROM (SELECT *,
     cast(floor((d*(CASE WHEN v = 0 THEN 0 ELSE round_even(1044480.0e0/v, 0) END)+2048)/4096.0e0) AS INTEGER) AS hsv_s,
     cast(floor((CASE WHEN v = r THEN g-b WHEN v = g THEN b-r+2*d ELSE r-g+4*d END
       * (CASE WHEN d = 0 THEN 0 ELSE round_even(737280.0e0/(6.0e0*d), 0) END) + 2048)/4096.0e0) AS INTEGER) AS h0
     FROM (SELECT *, greatest(r,g,b) AS v, greatest(r,g,b)-least(r,g,b) AS d FROM {source})))"""


REDNESS = "CASE WHEN sqrt({a}*{a}+{b}*{b}) >= 1e-9 THEN {a}/sqrt({a}*{a}+{b}*{b}) END"


def _red(a: str, b: str) -> str:
    return REDNESS.format(a=a, b=b)


def _ery(a: str, b: str) -> str:
    red = _red(a, b)
    return f"CASE WHEN ({red}) > 0 THEN 100*log10(1/({red})) END"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.colour_counts(PIXELS.frame(spark, sf))


@query(
    "lab_of_colours",
    "M4 M5 M6",
    f"""SELECT DISTINCT r, g, b, {r('lab_l', 'lab_l')}, {r('lab_a', 'lab_a')}, {r('lab_b', 'lab_b')},
    {r(_red('lab_a', 'lab_b'), 'redness')}, {r(_ery('lab_a', 'lab_b'), 'erythema')} FROM {lab_sql(PX)}""",
)
def lab_of_colours(spark: SparkSession, sf: str) -> DataFrame:
    colours = PIXELS.frame(spark, sf).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    df = colour.with_lab(colours)
    a, b = F.col("lab_a"), F.col("lab_b")
    df = df.withColumns({"redness": colour.redness(a, b), "erythema": colour.erythema(a, b)})
    return published(df.drop("n"))


@query("hsv_of_colours", "M7", f"SELECT DISTINCT r, g, b, hsv_h, hsv_s, v AS hsv_v FROM {hsv_sql(PX)}")
def hsv_of_colours(spark: SparkSession, sf: str) -> DataFrame:
    colours = PIXELS.frame(spark, sf).select("r", "g", "b").distinct()
    return colour.with_hsv(colours).select("r", "g", "b", "hsv_h", "hsv_s", "hsv_v")


def _stress(c: str) -> str:
    return f"round_even(least(255.0e0, greatest(0.0e0, {c})), 0)"


@query(
    "stress_transform",
    "M8 M24",
    f"""SELECT image_id, {r(f"avg({_stress('r*1.25e0+12')})", 'r', 4)}, {r(f"avg({_stress('g*1.25e0')})", 'g', 4)},
    {r(f"avg({_stress('b*1.25e0-12')})", 'b', 4)}, {r('avg(CASE WHEN in_roi THEN r ELSE 0 END)', 'masked_r', 4)}
    FROM {PX} GROUP BY image_id""",
)
def stress_transform(spark: SparkSession, sf: str) -> DataFrame:
    px = PIXELS.frame(spark, sf)
    moved = colour.stressed(F.col("r"), F.col("g"), F.col("b"), 0.25, 12.0)
    masked = colour.masked(F.col("r"), F.col("in_roi"))
    df = px.select("image_id", *[c.alias(n) for n, c in moved.items()], masked.alias("m"))
    out = df.groupBy("image_id").agg(*[F.avg(c).alias(c) for c in "rgb"], F.avg("m").alias("masked_r"))
    return published(out, 4)


@query(
    "masked_mean_lab",
    "P2",
    f"""SELECT image_id, cast(count_if(roi) AS BIGINT) AS n_roi, {r('avg(lab_l) FILTER (WHERE roi)', 'lab_l')},
    {r('avg(lab_a) FILTER (WHERE roi)', 'lab_a')}, {r('avg(lab_b) FILTER (WHERE roi)', 'lab_b')}
    FROM {lab_sql(PX)} GROUP BY image_id""",
)
def masked_mean_lab(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.mean_lab(_counts(spark, sf)))


HUE = """SELECT image_id, CASE WHEN lo >= 1 THEN hi/lo END AS high_hue_ratio FROM (SELECT image_id,
 CASE WHEN count(*) >= 300 THEN quantile_cont(c, 0.01e0) ELSE min(c) END AS lo,
 CASE WHEN count(*) >= 300 THEN quantile_cont(c, 0.99e0) ELSE max(c) END AS hi FROM
 (SELECT image_id, unnest([r, g, b])::DOUBLE AS c FROM {src} WHERE roi) GROUP BY image_id)"""


@query(
    "high_hue_ratio",
    "P3",
    f"SELECT image_id, {r('high_hue_ratio', 'high_hue_ratio')} FROM ({HUE.format(src=PX)})",
)
def high_hue_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.high_hue_ratio(_counts(spark, sf)))


def otsu_sql(source: str) -> str:
    return f"""SELECT image_id, avg(lab_a) FILTER (WHERE bin > cut) - avg(lab_a) FILTER (WHERE bin <= cut) AS otsu_vessel_redness FROM
     (SELECT p.*, coalesce(cut, 0) AS cut FROM (SELECT *, least(255, greatest(0, cast(floor(lab_a*scale + shift) AS INTEGER))) AS bin FROM
       (SELECT *, -lo*scale AS shift FROM (SELECT *, CASE WHEN hi-lo > 2.220446049250313e-16 THEN 255.0e0*(1.0e0/(hi-lo)) ELSE 0.0e0 END AS scale
        FROM (SELECT *, min(lab_a) OVER (PARTITION BY image_id) AS lo, max(lab_a) OVER (PARTITION BY image_id) AS hi FROM {lab_sql(source)})))) p
      LEFT JOIN (SELECT image_id, arg_max(bin, (sigma, -bin)) FILTER (WHERE sigma > 0) AS cut FROM (
        SELECT image_id, bin, CASE WHEN least(q1, 1-q1) >= 1.1920929e-07 AND greatest(q1, 1-q1) <= 1 - 1.1920929e-07
          THEN q1*(1-q1)*pow(cm/cn - (tm-cm)/(tn-cn), 2) END AS sigma FROM (
        SELECT *, cn/tn AS q1 FROM (SELECT image_id, bin, cast(sum(n) OVER w AS DOUBLE) AS cn, cast(sum(n*bin) OVER w AS DOUBLE) AS cm,
          cast(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS tn, cast(sum(n*bin) OVER (PARTITION BY image_id) AS DOUBLE) AS tm
         FROM (SELECT image_id, least(255, greatest(0, cast(floor(lab_a*scale - lo*scale) AS INTEGER))) AS bin, count(*) AS n FROM
         (SELECT *, CASE WHEN hi-lo > 2.220446049250313e-16 THEN 255.0e0*(1.0e0/(hi-lo)) ELSE 0.0e0 END AS scale FROM
         (SELECT *, min(lab_a) OVER (PARTITION BY image_id) AS lo, max(lab_a) OVER (PARTITION BY image_id) AS hi FROM {lab_sql(source)})) GROUP BY 1, 2)
         WINDOW w AS (PARTITION BY image_id ORDER BY bin)) WHERE tn > cn)) GROUP BY image_id) c USING (image_id)) GROUP BY image_id"""


@query(
    "vessel_contrast",
    "P4 W12",
    f"SELECT image_id, {r('otsu_vessel_redness', 'otsu_vessel_redness', 4)} FROM ({otsu_sql(PX)})",
)
def vessel_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.vessel_contrast(_counts(spark, sf)), 4)


@query(
    "hsv_medians",
    "P5",
    f"""SELECT image_id, {r('median(hsv_h) FILTER (WHERE roi)', 'hsv_hue')}, {r('median(hsv_s) FILTER (WHERE roi)', 'hsv_sat')},
    {r('median(v) FILTER (WHERE roi)', 'hsv_val')} FROM {hsv_sql(PX)} GROUP BY image_id""",
)
def hsv_medians(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.colour_features(_counts(spark, sf)).select("image_id", "hsv_hue", "hsv_sat", "hsv_val"))


def features_sql(source: str, raw: str) -> str:
    return f"""SELECT image_id, {r('lab_l', 'lab_l', 4)}, {r('lab_a', 'lab_a', 4)}, {r('lab_b', 'lab_b', 4)},
    {r(_red('lab_a', 'lab_b'), 'redness_ratio', 4)}, {r(_ery('lab_a', 'lab_b'), 'erythema_index', 4)},
    {r('high_hue_ratio', 'high_hue_ratio', 4)}, {r('otsu_vessel_redness', 'otsu_vessel_redness', 4)},
    {r('hsv_hue', 'hsv_hue', 4)}, {r('hsv_sat', 'hsv_sat', 4)}, {r('hsv_val', 'hsv_val', 4)},
    {r('roi_r', 'roi_r', 4)}, {r('roi_g', 'roi_g', 4)}, {r('roi_b', 'roi_b', 4)}, unmasked FROM
    (SELECT image_id, avg(lab_l) FILTER (WHERE roi) AS lab_l, avg(lab_a) FILTER (WHERE roi) AS lab_a,
     avg(lab_b) FILTER (WHERE roi) AS lab_b, bool_and(in_roi IS NULL) AS unmasked FROM {lab_sql(source)} GROUP BY image_id)
    JOIN (SELECT image_id, median(hsv_h) FILTER (WHERE roi) AS hsv_hue, median(hsv_s) FILTER (WHERE roi) AS hsv_sat,
     median(v) FILTER (WHERE roi) AS hsv_val FROM {hsv_sql(source)} GROUP BY image_id) USING (image_id)
    JOIN (SELECT image_id, avg(r/255.0e0) FILTER (WHERE roi) AS roi_r, avg(g/255.0e0) FILTER (WHERE roi) AS roi_g,
     avg(b/255.0e0) FILTER (WHERE roi) AS roi_b FROM {raw} GROUP BY image_id) USING (image_id)
    LEFT JOIN ({HUE.format(src=source)}) USING (image_id) LEFT JOIN ({otsu_sql(source)}) USING (image_id)"""


@query("colour_features", "P1 P6 P10", features_sql(PX, PX))
def colour_features(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.colour_features(_counts(spark, sf)), 4)


def light_sql(source: str) -> str:
    return f"""(SELECT *, CASE WHEN (m_r/i_r+m_g/i_g+m_b/i_b)/3/255.0e0 > 1e-6 THEN ((m_r+m_g+m_b)/3/255.0e0)/((m_r/i_r+m_g/i_g+m_b/i_b)/3/255.0e0) ELSE 1 END AS scale
     FROM (SELECT image_id, m_r, m_g, m_b, {', '.join(f'CASE WHEN coalesce(o_{c}, m_{c}) > 1e-6 THEN coalesce(o_{c}, m_{c}) ELSE 1 END AS i_{c}' for c in 'rgb')}
     FROM (SELECT image_id, {', '.join(f'avg({c}) AS m_{c}, avg({c}) FILTER (WHERE in_roi = false) AS o_{c}' for c in 'rgb')} FROM {source} GROUP BY image_id)))"""


@query(
    "illuminant_grey_world",
    "P7",
    f"SELECT image_id, {', '.join(r(c, c) for c in ('i_r', 'i_g', 'i_b', 'scale'))} FROM {light_sql(PX)}",
)
def illuminant_grey_world(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.illuminant(_counts(spark, sf)))


LUM = "(0.2126e0*r+0.7152e0*g+0.0722e0*b)"
PATCH = f"""WITH t AS (SELECT *, max({LUM}) FILTER (WHERE in_roi = false) OVER (PARTITION BY image_id) AS t_out,
 max({LUM}) OVER (PARTITION BY image_id) AS t_all FROM {PX}),
 p AS (SELECT image_id, {', '.join(f'cast(max({c}) AS DOUBLE) AS i_{c}' for c in 'rgb')} FROM t
  WHERE (coalesce(in_roi = false, false) OR t_out IS NULL) AND {LUM} >= 0.99e0*coalesce(t_out, t_all) GROUP BY image_id),
 m AS (SELECT image_id, avg(r) AS m_r, avg(g) AS m_g, avg(b) AS m_b FROM {PX} GROUP BY image_id),
 e AS (SELECT image_id, m_r, m_g, m_b, {', '.join(f'CASE WHEN i_{c} > 1e-6 THEN i_{c} ELSE 1 END AS i_{c}' for c in 'rgb')} FROM p JOIN m USING (image_id))
 SELECT image_id, {', '.join(r(f'i_{c}', f'i_{c}') for c in 'rgb')},
 {r('(m_r+m_g+m_b)/(m_r/i_r+m_g/i_g+m_b/i_b)', 'scale')} FROM e"""


@query("illuminant_white_patch", "P7", PATCH)
def illuminant_white_patch(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.illuminant(_counts(spark, sf), "white_patch"))


def _fix(c: str) -> str:
    return f"cast(round_even(least(1.0e0, greatest(0.0e0, {c}/255.0e0/i_{c}*scale))*255.0e0, 0) AS INTEGER)"


BALANCED = f"""(SELECT p.image_id, in_roi, roi, {', '.join(f'{_fix(c)} AS {c}' for c in 'rgb')} FROM {PX} p JOIN {light_sql(PX)} USING (image_id))"""


@query(
    "balanced_colours",
    "P8",
    f"""SELECT image_id, {r('avg(r)', 'r', 3)}, {r('avg(g)', 'g', 3)}, {r('avg(b)', 'b', 3)}, count(*) AS n
    FROM {BALANCED} GROUP BY image_id""",
)
def balanced_colours(spark: SparkSession, sf: str) -> DataFrame:
    b = X.balanced(_counts(spark, sf))
    mean = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in "rgb"]
    return published(b.groupBy("image_id").agg(*mean, F.sum("n").alias("n")), 3)


@query("balanced_features", "P9 P10", features_sql(BALANCED, PX))
def balanced_features(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.balanced_features(_counts(spark, sf)), 4)


GREYED = f"(SELECT *, (r*9798+g*19235+b*3735+16384) >> 15 AS grey FROM {GR})"
STENCIL = f"""(SELECT *, coalesce(l, rr, grey)+coalesce(rr, l, grey)+coalesce(u, dd, grey)+coalesce(dd, u, grey)-4*grey AS laplacian FROM
 (SELECT *, lag(grey) OVER h AS l, lead(grey) OVER h AS rr, lag(grey) OVER v AS u, lead(grey) OVER v AS dd FROM {GREYED}
  WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)))"""


@query("laplacian_stencil", "J16", f"SELECT image_id, x, y, grey, laplacian FROM {STENCIL}")
def laplacian_stencil(spark: SparkSession, sf: str) -> DataFrame:
    px = GRID.frame(spark, sf).withColumn("grey", colour.grey(F.col("r"), F.col("g"), F.col("b")))
    return X.laplacian(px, "grey").select("image_id", "x", "y", "grey", "laplacian")


MEASURED = f"""SELECT image_id, avg(grey) AS luma, avg(CASE WHEN grey >= 255 THEN 1.0e0 ELSE 0.0e0 END) AS clipped, var_pop(laplacian) AS sharpness,
 avg(CASE WHEN in_roi THEN 1.0e0 ELSE 0.0e0 END) AS roi_area, cast(max(x)+1 AS INTEGER) AS width, cast(max(y)+1 AS INTEGER) AS height
 FROM {STENCIL} GROUP BY image_id"""


@query(
    "quality_measures",
    "P11",
    f"""SELECT image_id, {r('luma', 'luma')}, {r('clipped', 'clipped')}, {r('sharpness', 'sharpness', 4)},
    {r('roi_area', 'roi_area')}, width, height FROM ({MEASURED})""",
)
def quality_measures(spark: SparkSession, sf: str) -> DataFrame:
    df = X.quality_measures(GRID.frame(spark, sf))
    return published(df.withColumn("sharpness", F.round("sharpness", 4)))


SCORE = """0.4e0*least(1.0e0, greatest(0.0e0, 1-abs(luma-130)/130)) + 0.4e0*least(1.0e0, greatest(0.0e0, ln(1+sharpness)/ln(401.0e0)))
 + 0.2e0*CASE WHEN roi_area IS NULL THEN 1.0e0 ELSE least(1.0e0, greatest(0.0e0, roi_area/0.1e0)) END"""
REASON = """CASE WHEN height < 1 THEN 'DECODE_FAIL' WHEN luma < 40 THEN 'TOO_DARK' WHEN luma > 235 OR clipped > 0.02e0 THEN 'TOO_BRIGHT'
 WHEN sharpness < 40 THEN 'TOO_BLUR' WHEN roi_area < 0.015e0 OR roi_area > 0.85e0 THEN 'WRONG_FRAMING' END"""
REPORT = f"(SELECT *, reason IS NULL AS passed FROM (SELECT *, CASE WHEN height > 0 THEN {SCORE} ELSE 0 END AS score, {REASON} AS reason FROM {QU}))"


@query(
    "quality_report",
    "M17 P12",
    f"""SELECT doc_id, {r('score', 'score')}, reason, passed, CASE reason WHEN 'DECODE_FAIL' THEN 'This file holds no picture that can be opened.'
    WHEN 'TOO_DARK' THEN 'Not enough light: take it again near a window.'
    WHEN 'TOO_BRIGHT' THEN 'Too much light: turn off the flash or step out of the sun.'
    WHEN 'TOO_BLUR' THEN 'Out of focus: rest your hand and let the camera settle first.'
    WHEN 'WRONG_FRAMING' THEN 'The eyelid is too small, or cut off: bring it to the middle of the picture.' END AS message FROM {REPORT}""",
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.quality_report(QUALITY.frame(spark, sf)).select("doc_id", "score", "reason", "passed", "message"))


@query(
    "quality_threshold_sweep",
    "A39 J12",
    f"""SELECT t AS threshold, cast(count_if(score < t) AS BIGINT) AS abstain, count(*) AS n, {r('avg(CASE WHEN score < t THEN 1.0e0 ELSE 0.0e0 END)', 'share')},
    t = 0.6e0 AS live, count_if(score < t) = 0 AS inert FROM {REPORT}, (VALUES (0.35e0), (0.6e0), (0.65e0), (0.7e0), (0.75e0), (0.8e0), (0.85e0)) v(t)
    WHERE passed GROUP BY t""",
)
def quality_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.threshold_sweep(X.quality_report(QUALITY.frame(spark, sf))))


@query(
    "quality_reasons",
    "A39 O2",
    f"SELECT reason, count(*) AS n FROM {REPORT} WHERE NOT passed GROUP BY reason",
)
def quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return X.reason_counts(X.quality_report(QUALITY.frame(spark, sf)))


@query(
    "quality_distribution",
    "A38 A39: exact quantiles by position",
    f"""SELECT passed, count(*) AS n, {r('min(score)', 'lowest')}, {r('quantile_cont(score, 0.05e0)', 'p05')},
    {r('median(score)', 'median')}, {r('max(score)', 'highest')} FROM {REPORT} GROUP BY passed""",
)
def quality_distribution(spark: SparkSession, sf: str) -> DataFrame:
    report = X.quality_report(QUALITY.frame(spark, sf)).select("doc_id", "passed", "score")
    probs = {"lowest": 0.0, "p05": 0.05, "median": 0.5, "highest": 1.0}
    return published(O.exact_quantiles(report, "score", "doc_id", probs, by=["passed"]))


@query(
    "area_distribution_line",
    "A38: min, p10 by index, median, max",
    f"""SELECT lang, count(*) AS n, {r('min(a)', 'lowest')}, {r('max(a) FILTER (WHERE rn = n//10 + 1)', 'p10')}, {r('median(a)', 'median')},
    {r('max(a)', 'highest')} FROM (SELECT lang, roi_area AS a, row_number() OVER (PARTITION BY lang ORDER BY roi_area) AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM {QU} WHERE roi_area IS NOT NULL) GROUP BY lang""",
)
def area_distribution_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = QUALITY.frame(spark, sf).where("roi_area is not null").select("doc_id", "lang", "roi_area")
    return published(O.distribution_line(rows, "roi_area", "doc_id", by=["lang"]))


@query(
    "frame_resolutions",
    "A40 O4",
    f"""SELECT height, width, n, n = max(n) OVER () AS most_common FROM (SELECT height, width, count(*) AS n FROM {QU}
    WHERE height > 0 GROUP BY height, width)""",
)
def frame_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    return X.resolutions(QUALITY.frame(spark, sf))


BOX = f"""(SELECT image_id, width, height, CASE WHEN x0 IS NOT NULL THEN greatest(0, x0-pad) END AS x0,
 CASE WHEN x0 IS NOT NULL THEN least(width, x1+pad) END AS x1, CASE WHEN x0 IS NOT NULL THEN greatest(0, y0-pad) END AS y0,
 CASE WHEN x0 IS NOT NULL THEN least(height, y1+pad) END AS y1 FROM (SELECT *, cast(greatest(2, floor(0.1e0*greatest(x1-x0, y1-y0))) AS INTEGER) AS pad FROM (SELECT image_id,
 min(x) FILTER (WHERE in_roi) AS x0, max(x) FILTER (WHERE in_roi)+1 AS x1, min(y) FILTER (WHERE in_roi) AS y0,
 max(y) FILTER (WHERE in_roi)+1 AS y1, max(x)+1 AS width, max(y)+1 AS height FROM {GR} GROUP BY image_id)))"""


@query("bounding_box", "A42", f"SELECT * FROM {BOX}")
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    return X.bounding_box(GRID.frame(spark, sf))


@query(
    "measured_panel",
    "P14 A42",
    f"""SELECT image_id, cast(floor(mr+0.5e0) AS BIGINT) AS mean_r, cast(floor(mg+0.5e0) AS BIGINT) AS mean_g, cast(floor(mb+0.5e0) AS BIGINT) AS mean_b,
    {r('lab_l', 'lab_l')}, {r('lab_a', 'lab_a')}, {r('lab_b', 'lab_b')}, {r(_ery('lab_a', 'lab_b'), 'erythema_index')},
    {r(_red('lab_a', 'lab_b'), 'redness_ratio')} FROM (SELECT p.image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, avg(lab_l) AS lab_l,
    avg(lab_a) AS lab_a, avg(lab_b) AS lab_b FROM {lab_sql(GR)} p JOIN {BOX} q ON p.image_id = q.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1
    GROUP BY p.image_id)""",
)
def measured_panel(spark: SparkSession, sf: str) -> DataFrame:
    return published(X.measured_panel(GRID.frame(spark, sf)))


@query(
    "mask_on_frame",
    "J13",
    f"""WITH m AS ({MASK_GRID.sql()}), f AS (SELECT image_id, max(x)+1 AS w, max(y)+1 AS h FROM {GR} GROUP BY image_id),
    s AS (SELECT image_id, max(mx)+1 AS mw, max(my)+1 AS mh FROM m GROUP BY image_id)
    SELECT p.image_id, x, y, mask_on AS in_roi FROM {GR} p JOIN f ON f.image_id = p.image_id LEFT JOIN s ON s.image_id = p.image_id
    LEFT JOIN m ON p.image_id = m.image_id AND m.mx = floor(x*mw/cast(w AS DOUBLE)) AND m.my = floor(y*mh/cast(h AS DOUBLE))""",
)
def mask_on_frame(spark: SparkSession, sf: str) -> DataFrame:
    out = X.mask_on_frame(GRID.frame(spark, sf), MASK_GRID.frame(spark, sf))
    return out.select("image_id", "x", "y", "in_roi")


@query(
    "geometry_report",
    "A41 P13",
    f"""SELECT lang AS roi, coalesce(CASE WHEN height < 1 THEN 'uncroppable' WHEN abs((width/height)/(3984.0e0/2984) - 1) > 0.02e0 THEN 'misaligned'
    WHEN a = 0 THEN 'uncroppable' WHEN a NOT BETWEEN 0.015e0 AND 0.85e0 THEN 'area' END, 'ok') AS problem, count(*) AS n,
    {r('avg(a)', 'mean_area')} FROM (SELECT *, coalesce(roi_area, 0) AS a FROM {QU}) GROUP BY ALL""",
)
def geometry_report(spark: SparkSession, sf: str) -> DataFrame:
    q = QUALITY.frame(spark, sf).withColumnRenamed("doc_id", "patient_id")
    masks = q.select("patient_id", F.col("lang").alias("roi"), F.coalesce("roi_area", F.lit(0.0)).alias("area"), "height", "width")
    frames = q.select("patient_id", F.lit(2984).alias("height"), F.lit(3984).alias("width"))
    g = X.geometry(frames, masks)
    return published(
        g.groupBy("roi", F.coalesce("problem", F.lit("ok")).alias("problem")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("area").alias("mean_area")
        )
    )
