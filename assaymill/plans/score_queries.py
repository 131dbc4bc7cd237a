"""Screening, calibration, fairness, coverage and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import BIN_CENTRES, CONFOUND_NOTE, NO_PROBABILITY
from assaymill.functions import gates, pigment, prob, who
from assaymill.operators import bootstrap as B
from assaymill.operators import calibration as C
from assaymill.operators import coverage as V
from assaymill.operators import fairness as E
from assaymill.operators import ordered as O
from assaymill.operators import row_bootstrap as RB
from assaymill.operators import screening as S
from assaymill.operators.clean import finite_rows
from assaymill.plans.registry import published, query, r
from assaymill.plans.views import LOGITS, PRED

P = f"({PRED.sql()})"
OK = f"(SELECT *, y_pred - y_true AS d FROM {P} WHERE y_pred IS NOT NULL)"
SCORED = f"(SELECT *, CASE WHEN abs(d) <= 1 THEN 1.0e0 ELSE 0.0e0 END AS hit FROM {OK})"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN cast({a} AS DOUBLE) / ({b}) END"


RATES = f"""tp, fn, fp, tn, tp+fn+fp+tn AS n, tp+fn AS positives, {r(_div('tp', 'tp+fn'), 'sensitivity')},
 {r(_div('tn', 'tn+fp'), 'specificity')}, {r(_div('tp', 'tp+fp'), 'ppv')}, {r(_div('tn', 'tn+fn'), 'npv')},
 CASE WHEN tp+fn+fp+tn = 0 THEN 'not_computable' WHEN tp+fn+fp+tn < 20 THEN 'underpowered'
 WHEN tp+fn = 0 OR tn+fp = 0 THEN 'not_computable' ELSE 'ok' END AS verdict"""
POOLED_SITE = "CASE WHEN grouping(site) = 1 THEN 'pooled' ELSE site END AS site"
CUT = "CASE WHEN sex = 'M' THEN 13.0e0 ELSE 12.0e0 END"


def _cells(cut: str) -> str:
    def n(a: str, b: str) -> str:
        return f"cast(count_if(y_true {a} {cut} AND y_pred {b} {cut}) AS BIGINT)"

    return f"{n('<', '<')} AS tp, {n('<', '>=')} AS fn, {n('>=', '<')} AS fp, {n('>=', '>=')} AS tn"


def _banded(source: str, group: str, grouping: str) -> str:
    parts = [("anaemia", CUT, "NULL"), ("moderate_or_worse", "9.0e0", "9.0e0"), ("severe", "7.0e0", "7.0e0")]
    return " UNION ALL ".join(
        f"SELECT {group}, '{band}' AS band, cast({mark} AS DOUBLE) AS threshold, {_cells(cut)}"
        f" FROM {source} GROUP BY {grouping}"
        for band, cut, mark in parts
    )


@query(
    "screening_at_cutoff",
    "A21 A22",
    f"SELECT site, {RATES} FROM (SELECT site, {_cells('12.0e0')} FROM {OK} GROUP BY site)",
)
def screening_at_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return published(S.threshold_metrics(PRED.frame(spark, sf), F.lit(12.0), by=["site"]))


@query(
    "screening_bands",
    "A23 J12 M1",
    f"SELECT head, band, threshold, {RATES} FROM ({_banded(OK, 'head', 'head')})",
)
def screening_bands(spark: SparkSession, sf: str) -> DataFrame:
    return published(S.screening(PRED.frame(spark, sf), by=["head"]))


@query(
    "screening_by_group_underpowered",
    "A24 A22: small groups and empty bands",
    f"SELECT l_suppkey, site, band, threshold, {RATES} FROM"
    f" ({_banded(f'(SELECT * FROM {OK} WHERE y_true >= 7 AND ita > 40)', 'l_suppkey, site', 'l_suppkey, site')})",
)
def screening_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = PRED.frame(spark, sf).where("y_true >= 7 and ita > 40")
    return published(S.screening(rows, by=["l_suppkey", "site"]))


@query(
    "screening_report",
    "A25",
    f"SELECT site, band, threshold, {RATES} FROM ({_banded(OK, POOLED_SITE, 'GROUPING SETS ((site), ())')})",
)
def screening_report(spark: SparkSession, sf: str) -> DataFrame:
    return published(S.screening(PRED.frame(spark, sf), by=["site"], pooled=True))


EDGES = gates.inner_edges(10)
BIN = " + ".join(f"CASE WHEN conf >= {e!r}e0 THEN 1 ELSE 0 END" for e in EDGES)
BINNED = f"(SELECT *, {BIN} AS bin FROM (SELECT *, confidence AS conf FROM {SCORED}))"


def _hit(df: DataFrame) -> DataFrame:
    return finite_rows(df, "y_true", "y_pred").withColumn("hit", F.abs(F.col("y_pred") - F.col("y_true")) <= 1.0)


@query(
    "calibration_error",
    "A26 M14",
    f"""SELECT head, cast(sum(n) AS BIGINT) AS n, {r('sum(n*abs(acc-conf))/sum(n)', 'ece')} FROM
    (SELECT head, bin, count(*) AS n, avg(conf) AS conf, avg(hit) AS acc FROM {BINNED} GROUP BY head, bin)
    GROUP BY head""",
)
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    curve = C.reliability(_hit(PRED.frame(spark, sf)), "confidence", "hit", ["head"])
    return published(C.calibration_error(curve, ["head"]))


@query(
    "brier_score",
    "A27",
    f"SELECT site, {r('avg((confidence-hit)*(confidence-hit))', 'brier')} FROM {SCORED} GROUP BY site",
)
def brier_score(spark: SparkSession, sf: str) -> DataFrame:
    return published(C.brier(_hit(PRED.frame(spark, sf)), "confidence", "hit", ["site"]))


@query(
    "reliability_curve",
    "A28",
    f"""SELECT bin, count(*) AS n, {r('avg(conf)', 'confidence')}, {r('avg(hit)', 'accuracy')}
    FROM {BINNED} GROUP BY bin""",
)
def reliability_curve(spark: SparkSession, sf: str) -> DataFrame:
    return published(C.reliability(_hit(PRED.frame(spark, sf)), "confidence", "hit"))


@query(
    "reliability_by_site",
    "A29",
    f"""SELECT CASE WHEN grouping(site) = 1 THEN 'pooled' ELSE site END AS site, bin, count(*) AS n,
    {r('avg(conf)', 'confidence')}, {r('avg(hit)', 'accuracy')} FROM {BINNED}
    GROUP BY GROUPING SETS ((site, bin), (bin))""",
)
def reliability_by_site(spark: SparkSession, sf: str) -> DataFrame:
    return published(C.reliability(_hit(PRED.frame(spark, sf)), "confidence", "hit", ["site"], pooled=True))


ECE_SITE = f"""SELECT site, cast(sum(n) AS BIGINT) AS n, sum(n*abs(acc-conf))/sum(n) AS ece FROM
 (SELECT CASE WHEN grouping(site) = 1 THEN 'pooled' ELSE site END AS site, bin, count(*) AS n,
 avg(conf) AS conf, avg(hit) AS acc FROM {BINNED} GROUP BY GROUPING SETS ((site, bin), (bin))) GROUP BY site"""


@query(
    "site_calibration_audit",
    "A30",
    f"""WITH e AS ({ECE_SITE}) SELECT site, n, {r('ece', 'ece')},
    (SELECT {r("CASE WHEN count(*) >= 2 THEN max(ece) - min(ece) END", 'g')} FROM e WHERE site <> 'pooled') AS max_ece_gap,
    true AS available, cast(NULL AS VARCHAR) AS reason, '{CONFOUND_NOTE}' AS note FROM e""",
)
def site_calibration_audit(spark: SparkSession, sf: str) -> DataFrame:
    return published(C.site_calibration(_hit(PRED.frame(spark, sf)), "confidence", "hit", "site"))


@query(
    "site_calibration_unavailable",
    "A30: no probability column",
    f"""SELECT 'pooled' AS site, count(*) AS n, cast(NULL AS DOUBLE) AS ece, cast(NULL AS DOUBLE) AS max_ece_gap,
    false AS available, '{NO_PROBABILITY}' AS reason, '{CONFOUND_NOTE}' AS note FROM {OK}""",
)
def site_calibration_unavailable(spark: SparkSession, sf: str) -> DataFrame:
    return C.site_calibration(finite_rows(PRED.frame(spark, sf), "y_true", "y_pred"), None, None, "site")


# --- temperature --------------------------------------------------------------

K = len(BIN_CENTRES)
L = f"({LOGITS.sql()})"
LONG = (
    "(SELECT id, target, split, y_true, sex, k, z FROM (SELECT *, unnest(range(0,12)) AS k,"
    f" unnest([{', '.join(f'z{i}' for i in range(1, 13))}]) AS z FROM {L}))"
)
GRID = ", ".join(f"({i}, {t!r}e0)" for i, t in enumerate(C.temperature_grid()))


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.col(f"z{i}") for i in range(1, K + 1)]
    return LOGITS.frame(spark, sf).withColumn("logits", F.array(*cols))


NLL = f"""WITH v AS (SELECT *, max(z) OVER (PARTITION BY id) AS top FROM {LONG} WHERE split = 'val'),
 g(i, t) AS (VALUES {GRID}),
 q AS (SELECT i, t, id, max(CASE WHEN k = target THEN exp((z-top)/t) END)/sum(exp((z-top)/t)) AS p
       FROM v, g GROUP BY i, t, id),
 nll AS (SELECT i, t, avg(-ln(least(1.0e0, greatest(1e-12, p)))) AS nll FROM q GROUP BY i, t)"""


@query(
    "temperature_curve",
    "J10",
    f"{NLL} SELECT {r('t', 'temperature')}, {r('nll', 'nll')} FROM nll",
)
def temperature_curve(spark: SparkSession, sf: str) -> DataFrame:
    val = C.ValidationSplit.of(_logits(spark, sf))
    return published(C.temperature_curve(val, "logits", "target", K))


STAGES = f"""{NLL}, best AS (SELECT arg_min(t, (nll, t)) AS t FROM nll),
 s AS (SELECT 'before' AS stage, 1.0e0 AS t UNION ALL SELECT 'after', t FROM best),
 m AS (SELECT stage, id, max(exp((z-top)/t))/sum(exp((z-top)/t)) AS conf,
       CASE WHEN arg_max(k, (z, -k)) = any_value(target) THEN 1.0e0 ELSE 0.0e0 END AS hit
       FROM v, s GROUP BY stage, id),
 b AS (SELECT stage, {BIN} AS bin, count(*) AS n, avg(conf) AS conf, avg(hit) AS acc
       FROM m GROUP BY stage, {BIN}),
 e AS (SELECT stage, sum(n*abs(acc-conf))/sum(n) AS ece FROM b GROUP BY stage)"""


@query(
    "temperature_scaling",
    "A31 M9",
    f"""{STAGES} SELECT {r('(SELECT t FROM best)', 'temperature')},
    {r("(SELECT ece FROM e WHERE stage = 'before')", 'ece_before')},
    {r("(SELECT ece FROM e WHERE stage = 'after')", 'ece_after')}""",
)
def temperature_scaling(spark: SparkSession, sf: str) -> DataFrame:
    return published(C.temperature_scale(C.ValidationSplit.of(_logits(spark, sf)), "logits", "target", K))


# --- fairness -----------------------------------------------------------------

Z = 1.959963984540054
TCRIT = (
    f"({Z}e0 + ({Z**3 + Z}e0)/(4*dof) + ({5 * Z**5 + 16 * Z**3 + 3 * Z}e0)/(96*dof*dof)"
    f" + ({3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z}e0)/(384*dof*dof*dof))"
)


def _slope_sql(y: str, rows: str, group: str) -> str:
    # A flat covariate has slope zero around the mean, with nothing explained.
    return f"""SELECT *, n-2 AS dof, CASE WHEN flat THEN 0 ELSE 1 - (syy - slope*sxy)/syy END AS r2,
    CASE WHEN flat THEN 0 ELSE sqrt((syy - slope*sxy)/(n-2)/sxx) END AS se FROM (SELECT * EXCLUDE (raw, cut),
    CASE WHEN flat THEN 0 ELSE raw END AS slope, CASE WHEN flat THEN my ELSE cut END AS intercept FROM (
    SELECT {group}, count(*) AS n, regr_slope({y}, ita) AS raw, regr_intercept({y}, ita) AS cut, avg({y}) AS my,
    regr_sxx({y}, ita) AS sxx, regr_syy({y}, ita) AS syy, regr_sxy({y}, ita) AS sxy, regr_sxx({y}, ita) < 1e-12 AS flat
    FROM {rows} GROUP BY {group}))"""


GATED = f"""n, {r('slope', 'slope', 7)}, {r('intercept', 'intercept')}, {r('r2', 'r2')},
 {r('se', 'se', 7)}, {r(f'slope - {TCRIT}*se', 'ci_low')}, {r(f'slope + {TCRIT}*se', 'ci_high')},
 CASE WHEN n < 20 THEN 'underpowered' WHEN (slope - {TCRIT}*se)*(slope + {TCRIT}*se) > 0
 AND abs(slope) >= 0.002e0 THEN 'supported' ELSE 'not_supported' END AS verdict"""


def _slopes(df: DataFrame) -> DataFrame:
    digits = {"slope": 7, "se": 7, "intercept": 6, "r2": 6, "ci_low": 6, "ci_high": 6}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "bias_slope",
    "A16 A17 A18 F12",
    f"SELECT site, {GATED} FROM ({_slope_sql('d', OK, 'site')})",
)
def bias_slope(spark: SparkSession, sf: str) -> DataFrame:
    return _slopes(E.bias_slope(PRED.frame(spark, sf), "ita", by=["site"]).drop("p_value"))


@query("bias_slope_p_values", "A17: two-sided p of the slope per head (no t distribution in SQL)")
def bias_slope_p_values(spark: SparkSession, sf: str) -> DataFrame:
    return published(E.bias_slope(PRED.frame(spark, sf), "ita", by=["head", "sex"], confidence=0.99))


@query(
    "calibration_slope",
    "A19",
    f"""SELECT sex, {GATED}, 'calibration error is associated with ita' AS hypothesis
    FROM ({_slope_sql('(confidence - hit)', SCORED, 'sex')})""",
)
def calibration_slope(spark: SparkSession, sf: str) -> DataFrame:
    return _slopes(
        E.calibration_slope(_hit(PRED.frame(spark, sf)), "ita", "confidence", "hit", by=["sex"]).drop("p_value")
    )


# --- ordered analytics --------------------------------------------------------


@query(
    "average_rank_summary",
    "W1: ranks of the prediction, ties averaged",
    f"""SELECT site, count(*) AS n, {r('avg(rk)', 'mean_rank')}, {r('max(rk)', 'max_rank')},
    {r('stddev_pop(rk)', 'sd_rank', 3)} FROM (SELECT site, rank() OVER (ORDER BY y_true)
    + (count(*) OVER (PARTITION BY y_true) - 1)/2.0e0 AS rk FROM {OK}) GROUP BY site""",
)
def average_rank_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = finite_rows(PRED.frame(spark, sf), "y_true", "y_pred").select("id", "site", "y_true")
    ranked = O.average_rank(rows, "y_true", "id", "rk")
    out = ranked.groupBy("site").agg(
        F.count("rk").alias("n"),
        F.round(F.avg("rk"), 6).alias("mean_rank"),
        F.round(F.max("rk"), 6).alias("max_rank"),
        F.round(F.stddev_pop("rk"), 3).alias("sd_rank"),
    )
    return out


@query(
    "spearman_by_site",
    "A6 W1",
    f"""SELECT site, count(*) AS n, {r('covar_pop(a,b)/(stddev_pop(a)*stddev_pop(b))', 'spearman_rho')} FROM (
    SELECT site, rank() OVER (PARTITION BY site ORDER BY y_true)
      + (count(*) OVER (PARTITION BY site, y_true) - 1)/2.0e0 AS a,
    rank() OVER (PARTITION BY site ORDER BY y_pred)
      + (count(*) OVER (PARTITION BY site, y_pred) - 1)/2.0e0 AS b FROM {OK}) GROUP BY site""",
)
def spearman_by_site(spark: SparkSession, sf: str) -> DataFrame:
    rows = finite_rows(PRED.frame(spark, sf), "y_true", "y_pred")
    return published(O.spearman(rows, "y_true", "y_pred", "id", by=["site"]))


FRACTIONS = ", ".join(f"({i}, {f!r}e0)" for i, f in enumerate(V.fractions()))


def _curve_sql(group: str) -> str:
    over = f"PARTITION BY {group}" if group else ""
    pick = f"{group}, " if group else ""
    match = f"AND k.{group} = o.{group}" if group else ""
    return f"""WITH o AS (SELECT {pick} 1 - confidence AS unc, row_number() OVER w AS rn,
     avg(abs(d)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {OK}
     WINDOW w AS ({over} ORDER BY 1 - confidence, md5(id))),
     f(point, frac) AS (VALUES {FRACTIONS}),
     k AS (SELECT {pick} point, n, cast(greatest(1, round_even(frac*n, 0)) AS BIGINT) AS k
           FROM (SELECT {pick} count(*) AS n FROM o {'GROUP BY ' + group if group else ''}), f),
     c AS (SELECT {'k.' + group + ',' if group else ''} point, n, k, round(k/n, 4) AS coverage, run AS mae, unc AS threshold
           FROM k JOIN o ON o.rn = k.k {match})"""


def _uncertain(spark: SparkSession, sf: str) -> DataFrame:
    return PRED.frame(spark, sf).withColumn("unc", 1 - F.col("confidence"))


@query(
    "risk_coverage_curve",
    "W2",
    f"{_curve_sql('')} SELECT point, n, k, coverage, {r('mae', 'mae')}, {r('threshold', 'threshold')} FROM c",
)
def risk_coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    return published(V.risk_coverage(_uncertain(spark, sf), "unc", "id"))


@query(
    "risk_coverage_by_head",
    "W3",
    f"{_curve_sql('head')} SELECT head, point, n, k, coverage, {r('mae', 'mae')}, {r('threshold', 'threshold')} FROM c",
)
def risk_coverage_by_head(spark: SparkSession, sf: str) -> DataFrame:
    return published(V.risk_coverage(_uncertain(spark, sf), "unc", "id", by=["head"]))


@query(
    "coverage_summary",
    "W4",
    f"""{_curve_sql('')}, t(target) AS (VALUES (1.0e0), (0.9e0), (0.8e0), (0.7e0)),
    x AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(coverage-target), point) AS pick FROM c, t)
    SELECT target, coverage, {r('mae', 'mae')}, {r('threshold', 'threshold')}, {r('1-coverage', 'rejected')}
    FROM x WHERE pick = 1""",
)
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    curve = V.risk_coverage(_uncertain(spark, sf), "unc", "id")
    return published(V.at_coverages(curve, [1.0, 0.9, 0.8, 0.7]))


@query(
    "abstention_threshold",
    "W5",
    f"""{_curve_sql('head')} SELECT head, {r('''coalesce(arg_min(threshold, point) FILTER (WHERE coverage <= 0.75e0),
    arg_max(threshold, point))''', 'threshold')} FROM c GROUP BY head""",
)
def abstention_threshold(spark: SparkSession, sf: str) -> DataFrame:
    curve = V.risk_coverage(_uncertain(spark, sf), "unc", "id", by=["head"])
    return published(V.abstention_threshold(curve, 0.75, ["head"]))


HASH = "cast(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
BLOCKS = f"""SELECT {{group}} {HASH.format('id')} % {{n}} AS block, count(*) AS m, sum(d) AS s
 FROM {OK} GROUP BY ALL"""


def _unit(*parts: str) -> str:
    text = " || '|' || ".join(f"cast({p} AS VARCHAR)" for p in parts)
    return f"({HASH.format(text)} / 4294967296.0e0)"


WEIGHT = " + ".join(f"CASE WHEN u >= {c!r}e0 THEN 1 ELSE 0 END" for c in B.poisson_steps())
BOOT = f"""count(stat) AS replicates, {r('avg(stat)', 'boot_mean')},
 {r('quantile_cont(stat, 0.025e0)', 'ci_low')}, {r('quantile_cont(stat, 0.975e0)', 'ci_high')}"""


@query(
    "bias_bootstrap",
    "A12 J11: Poisson weights per random block",
    f"""WITH b AS ({BLOCKS.format(group='site,', n=1024)}),
    h AS (SELECT rep, block, {WEIGHT} AS w FROM (SELECT rep, block, {_unit('42', 'rep', 'block')} AS u
          FROM range(2000) a(rep), range(1024) c(block))),
    s AS (SELECT site, rep, sum(w*s)/sum(w*m) AS stat FROM h JOIN b USING (block) GROUP BY site, rep)
    SELECT site, {BOOT}, 'poisson block' AS method, 1024 AS n_blocks FROM s GROUP BY site""",
)
def bias_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return published(B.bias_interval(PRED.frame(spark, sf), "id", by=["site"]))


@query(
    "bias_bootstrap_exact",
    "A12 J11: as many draws with replacement as blocks",
    f"""WITH b AS ({BLOCKS.format(group='', n=256)}),
    h AS (SELECT rep, cast(floor({_unit('42', 'rep', 'draw')} * 256) AS BIGINT) AS block
          FROM range(2000) a(rep), range(256) c(draw)),
    s AS (SELECT rep, sum(s)/sum(m) AS stat FROM h JOIN b USING (block) GROUP BY rep)
    SELECT {BOOT}, 'multinomial block' AS method, 256 AS n_blocks FROM s""",
)
def bias_bootstrap_exact(spark: SparkSession, sf: str) -> DataFrame:
    return published(B.bias_interval_multinomial(PRED.frame(spark, sf), "id"))


# 32-bit arithmetic in unsigned 64 bits, as the counters of the row bootstrap.
def _mix32(x: str) -> str:
    one = f"xor({x}, {x} >> 16)"
    return f"(({one} * {RB.MIX[0]}::UBIGINT) & 4294967295::UBIGINT)"


def _mixed(x: str, source: str, columns: str, out: str) -> str:
    """SELECT with ``out`` = the finaliser of ``x``, step by step so that no term repeats."""
    return f"""(SELECT {columns}, xor(m2, m2 >> 16) AS {out} FROM (SELECT {columns}, (xor(m1, m1 >> 13) * {RB.MIX[1]}::UBIGINT) & 4294967295::UBIGINT AS m2
        FROM (SELECT {columns}, {_mix32('m0')} AS m1 FROM (SELECT {columns}, ({x}) & 4294967295::UBIGINT AS m0 FROM {source}))))"""


_HALF = "cast(('0x' || substr(md5('42|' || id), {}, 8)) AS UBIGINT)"
_REPS = "(SELECT cast(i AS UBIGINT) AS rep FROM range(2000) x(i))"
_ROWS = f"(SELECT site, d, {_HALF.format(1)} AS a, {_HALF.format(9)} AS b FROM {OK})"
_INNER = _mixed(f"b + rep * {RB.GOLDEN}::UBIGINT", f"({_ROWS} CROSS JOIN {_REPS})", "site, d, rep, a", "h")
_DRAWN = _mixed("xor(a, h)", _INNER, "site, d, rep", "u")
_COUNT = " + ".join(f"CASE WHEN u >= {c}::UBIGINT THEN 1 ELSE 0 END" for c in RB.STEPS if c < 2**32)


@query(
    "bias_bootstrap_rows",
    "A12 J11: Poisson weights per row",
    f"""WITH s AS (SELECT site, rep, sum(w*d)/sum(w) AS stat FROM (SELECT site, rep, d, {_COUNT} AS w FROM {_DRAWN}) GROUP BY site, rep),
    n AS (SELECT site, count(*) AS n_rows FROM {OK} GROUP BY site)
    SELECT site, {BOOT}, 'poisson row' AS method, any_value(n_rows) AS n_rows FROM s JOIN n USING (site) GROUP BY site""",
)
def bias_bootstrap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return published(RB.bias_interval_rows(PRED.frame(spark, sf), "id", by=["site"]))


_SEEDED = _mixed("rep + 42", _REPS, "rep", "r")
_NEXT = _mixed("rep + 43", _REPS, "rep", "r")
_J = f"(SELECT rep, r, j.i AS j, n FROM {_SEEDED} CROSS JOIN (SELECT count(*) AS n FROM {OK}) CROSS JOIN (SELECT cast(unnest(range((SELECT count(*) FROM {OK}))) AS UBIGINT) AS i) j)"
_J1 = _mixed(f"j * {RB.GOLDEN}::UBIGINT", _J, "rep, n, r", "h")
_J2 = _mixed("xor(r, h)", _J1, "rep, n", "u")
_K = f"(SELECT c.rep, r, block, cast(unnest(range(k)) AS UBIGINT) AS q FROM counted c JOIN {_NEXT} x ON x.rep = c.rep)"
_K1 = _mixed(f"((q * {RB.GOLDEN}::UBIGINT) & 4294967295::UBIGINT) + ((block * {RB.MIX[0]}::UBIGINT) & 4294967295::UBIGINT)", _K, "rep, block, r", "h")
_K2 = _mixed("xor(r, h)", _K1, "rep, block", "u")


@query(
    "bias_bootstrap_rows_exact",
    "A12 J11: as many draws with replacement as rows",
    f"""WITH p AS (SELECT d, row_number() OVER (ORDER BY md5('42|' || id), id, d) - 1 AS place FROM {OK}),
    counted AS (SELECT rep, cast(((u * n::UBIGINT) >> 32) // {RB.BLOCK} AS UBIGINT) AS block, count(*) AS k FROM {_J2} GROUP BY ALL),
    sizes AS (SELECT place // {RB.BLOCK} AS block, count(*) AS size FROM p GROUP BY 1),
    picks AS (SELECT rep, block * {RB.BLOCK} + ((u * size::UBIGINT) >> 32) AS place FROM {_K2} k JOIN sizes USING (block)),
    s AS (SELECT rep, avg(d) AS stat FROM picks JOIN p ON p.place = picks.place GROUP BY rep)
    SELECT {BOOT}, 'multinomial row' AS method, (SELECT count(*) FROM {OK}) AS n_rows FROM s""",
)
def bias_bootstrap_rows_exact(spark: SparkSession, sf: str) -> DataFrame:
    return published(RB.bias_interval_exact(PRED.frame(spark, sf), "id"))


# --- scalar functions ---------------------------------------------------------


@query(
    "severity_bands",
    "M1",
    f"""SELECT band, cutoff, idx, client, count(*) AS n FROM (SELECT *,
    CASE band WHEN 'normal' THEN 0 WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS idx FROM (SELECT
    CASE WHEN y_true < 7 THEN 'severe' WHEN y_true < 9 THEN 'moderate' WHEN y_true < {CUT} THEN 'mild'
    ELSE 'normal' END AS band, {CUT} AS cutoff, CASE WHEN y_true >= 12 THEN 'within_range'
    WHEN y_true >= 9 THEN 'mild' WHEN y_true >= 7 THEN 'moderate' ELSE 'severe' END AS client
    FROM {P})) GROUP BY ALL""",
)
def severity_bands(spark: SparkSession, sf: str) -> DataFrame:
    v, s = F.col("y_true"), F.col("sex")
    df = PRED.frame(spark, sf).select(
        who.severity_band(v, s).alias("band"), who.sex_cutoff(s).alias("cutoff"), who.client_band(v).alias("client")
    )
    df = df.withColumn("idx", who.severity_index(F.col("band")))
    return df.groupBy("band", "cutoff", "idx", "client").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pigment_bands",
    "M2 M3",
    f"""SELECT tone, pigment, count(*) AS n, {r('avg(angle)', 'angle')}, {r('avg(score)', 'score')} FROM (
    SELECT *, CASE WHEN angle >= 55 THEN 'very_light' WHEN angle >= 41 THEN 'light' WHEN angle >= 28 THEN 'intermediate'
    WHEN angle >= 10 THEN 'tan' WHEN angle >= -30 THEN 'brown' ELSE 'dark' END AS tone,
    CASE WHEN score < 0.25e0 THEN 'low' WHEN score < 0.5e0 THEN 'medium' ELSE 'high' END AS pigment FROM (
    SELECT degrees(atan2(5*y_true - 50, ita/3)) AS angle,
    least(1.0e0, greatest(0.0e0, (ita/3 + 10 - 5)/35)) AS score FROM {P})) GROUP BY tone, pigment""",
)
def pigment_bands(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf).select(
        pigment.ita_angle(5 * F.col("y_true"), F.col("ita") / 3).alias("angle"),
        pigment.pigment_score(F.col("ita") / 3 + 10).alias("score"),
    )
    df = df.withColumns({"tone": pigment.ita_band(F.col("angle")), "pigment": pigment.pigment_band(F.col("score"))})
    return published(
        df.groupBy("tone", "pigment").agg(
            F.count(F.lit(1)).alias("n"), F.avg("angle").alias("angle"), F.avg("score").alias("score")
        )
    )


CENTRES = ", ".join(f"({i}, {c!r}e0)" for i, c in enumerate(BIN_CENTRES))
POSTERIOR = f"""WITH c(k, mu) AS (VALUES {CENTRES}),
 p AS (SELECT l.id, l.k, mu, sex, exp(z - max(z) OVER w)/sum(exp(z)) OVER w * exp(max(z) OVER w) AS p
       FROM {LONG} l JOIN c USING (k) WINDOW w AS (PARTITION BY l.id))"""


@query(
    "posterior_decode",
    "M9 M10 M13 M12: ordinal",
    f"""{POSTERIOR} SELECT id, {r('sum(p*mu)/sum(p)', 'estimate')},
    {r('sqrt(greatest(sum(p*mu*mu)/sum(p) - pow(sum(p*mu)/sum(p), 2), 0))', 'sigma')},
    {r('sum(CASE WHEN mu < ' + CUT + ' THEN p ELSE 0 END)', 'p_low')}, {r('max(p)', 'top')} FROM p GROUP BY id""",
)
def posterior_decode(spark: SparkSession, sf: str) -> DataFrame:
    df = prob.softmax(_logits(spark, sf), "logits", "p")
    return published(
        df.select(
            "id",
            prob.expected_value("p", BIN_CENTRES).alias("estimate"),
            prob.predictive_sigma("p", BIN_CENTRES).alias("sigma"),
            prob.probability_below("p", who.sex_cutoff(F.col("sex"))).alias("p_low"),
            F.array_max("p").alias("top"),
        )
    )


@query(
    "soft_labels",
    "M11 J8 J9",
    f"""WITH c(k, mu) AS (VALUES {CENTRES}),
    s AS (SELECT y_true, mu, k, exp(-0.5e0*pow((y_true-mu)/0.6e0, 2)) AS w, abs(y_true-mu) AS gap
          FROM (SELECT DISTINCT y_true FROM {P}), c)
    SELECT y_true, {r('max(w)/sum(w)', 'top_share')}, {r('sum(w*mu)/sum(w)', 'soft_mean')},
    cast(arg_min(k, (gap, k)) AS INTEGER) AS nearest FROM s GROUP BY y_true""",
)
def soft_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf).groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))
    df = prob.soft_label(df, "y_true", "w")
    return published(
        df.select(
            "y_true",
            F.array_max("w").alias("top_share"),
            prob.expected_value("w", BIN_CENTRES).alias("soft_mean"),
            prob.nearest_centre(F.col("y_true")).alias("nearest"),
        )
    )


@query(
    "decode_heads",
    "M12: binary, severity and regression outputs",
    f"""SELECT id, {r('bv', 'binary_value')}, {r('sv', 'severity_value')}, {r('z3', 'regression_value')}
    FROM (SELECT id, z3, (1-s)*14.0e0 + s*10.0e0 AS bv,
    (exp(z1)*14 + exp(z2)*12 + exp(z3)*9 + exp(z4)*6)/(exp(z1)+exp(z2)+exp(z3)+exp(z4)) AS sv
    FROM (SELECT *, 1/(1+exp(-z1)) AS s FROM {L}))""",
)
def decode_heads(spark: SparkSession, sf: str) -> DataFrame:
    df = LOGITS.frame(spark, sf).select(
        "id",
        F.array("z1").alias("one"),
        F.array("z1", "z2", "z3", "z4").alias("four"),
        F.array("z3").alias("raw"),
    )
    df = prob.decode(df, "binary", "one", "binary_value", [14.0, 10.0])
    df = prob.decode(df, "severity", "four", "severity_value", [14.0, 12.0, 9.0, 6.0])
    df = prob.decode(df, "regression", "raw", "regression_value")
    return published(df.drop("one", "four", "raw"))


@query(
    "abstain_gate",
    "M15",
    f"""SELECT site, cast(count_if(sg IS NULL OR sg > 0.9e0 OR confidence < 0.6e0) AS BIGINT) AS abstained,
    count(*) AS n FROM (SELECT *, CASE WHEN y_pred IS NULL THEN NULL ELSE sigma END AS sg FROM {P}) GROUP BY site""",
)
def abstain_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf).withColumn("sg", F.when(F.col("y_pred").isNotNull(), F.col("sigma")))
    stop = gates.should_abstain(F.col("sg"), F.lit(0.9), F.col("confidence"))
    return df.groupBy("site").agg(F.count_if(stop).alias("abstained"), F.count(F.lit(1)).alias("n"))


@query(
    "value_interval",
    "M16",
    f"""SELECT head, {r('avg(y_pred - 1.959963984540054e0*s)', 'lo')}, {r('avg(y_pred + 1.959963984540054e0*s)', 'hi')},
    {r('avg(s)', 'sigma')} FROM (SELECT *, coalesce(CASE WHEN head = 'ordinal' THEN 0.5e0 END, sigma) AS s FROM {OK})
    GROUP BY head""",
)
def value_interval(spark: SparkSession, sf: str) -> DataFrame:
    df = finite_rows(PRED.frame(spark, sf), "y_true", "y_pred")
    known = F.when(F.col("head") == "ordinal", F.lit(0.5))
    box = df.select("head", gates.interval(F.col("y_pred"), F.col("sigma"), known).alias("i"))
    return published(
        box.groupBy("head").agg(
            F.avg("i.lo").alias("lo"), F.avg("i.hi").alias("hi"), F.avg("i.sigma").alias("sigma")
        )
    )


@query(
    "head_audit_block",
    "L8 M13: probability of the low class read from the class distribution, audited per site",
    f"""{POSTERIOR},
    s AS (SELECT p.id, sum(CASE WHEN mu < {CUT.replace('sex', 'p.sex')} THEN p ELSE 0 END) AS conf FROM p GROUP BY p.id),
    j AS (SELECT sex AS grp, conf, CASE WHEN y_true < {CUT} THEN 1.0e0 ELSE 0.0e0 END AS hit
          FROM {L} l JOIN s USING (id)),
    b AS (SELECT CASE WHEN grouping(grp) = 1 THEN 'pooled' ELSE grp END AS grp, {BIN} AS bin, count(*) AS n,
          avg(conf) AS conf, avg(hit) AS acc FROM j GROUP BY GROUPING SETS ((grp, {BIN}), ({BIN})))
    SELECT grp, cast(sum(n) AS BIGINT) AS n, {r('sum(n*abs(acc-conf))/sum(n)', 'ece')} FROM b GROUP BY grp""",
)
def head_audit_block(spark: SparkSession, sf: str) -> DataFrame:
    cut = who.sex_cutoff(F.col("sex"))
    rows = prob.softmax(_logits(spark, sf), "logits", "p").select(
        F.col("sex").alias("grp"),
        prob.probability_below("p", cut).alias("conf"),
        (F.col("y_true") < cut).alias("hit"),
    )
    audit = C.site_calibration(rows, "conf", "hit", "grp")
    return published(audit.select("grp", "n", "ece"))
