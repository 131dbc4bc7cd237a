"""Published values and hand arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.config import BIN_CENTRES
from assaymill.functions import colour, gates, names, pigment, prob, who
from assaymill.functions.student import critical_value, two_sided_p
from assaymill.operators import agreement as A
from assaymill.operators import calibration as C
from assaymill.operators import coverage as V
from assaymill.operators import fairness as E
from assaymill.operators import screening as S
from assaymill.operators.clean import finite_summary, rename_by_alias

TRUTH = [8.1, 9.4, 10.2, 11.0, 11.8, 12.4, 13.1, 14.0, 14.6, 15.2, 6.9, 10.9]
PRED = [8.6, 9.1, 10.5, 10.7, 12.2, 12.1, 13.4, 13.6, 15.0, 14.8, 7.5, 10.6]


def pairs(spark, t, p):
    return spark.createDataFrame(list(zip(t, p)), "y_true double, y_pred double")


def test_centres():
    assert BIN_CENTRES == (5.0, 6.5, 7.5, 8.5, 9.5, 10.5, 11.5, 12.5, 13.5, 14.5, 15.5, 17.0)


def test_severity(spark):
    cases = [
        (6.99, "M", "severe"), (7.0, "M", "moderate"), (7.0, "F", "moderate"), (8.99, "F", "moderate"),
        (9.0, "M", "mild"), (11.99, "F", "mild"), (12.0, "F", "normal"), (12.01, "M", "mild"), (12.99, "M", "mild"),
        (13.0, "M", "normal"),
    ]
    df = spark.createDataFrame(cases, "v double, s string, want string")
    got = df.select("want", who.severity_band(F.col("v"), F.col("s")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    sexes = spark.createDataFrame([(s,) for s in ("M", "F", "male", "female", "unknown", None)], "s string")
    assert [r[0] for r in sexes.select(who.sex_cutoff(F.col("s"))).collect()] == [13, 12, 13, 12, 12, 12]


def test_label_cells(spark):
    cases = [
        ("13.7", 13.7, None), ("15,1", 15.1, None), ("  13,7 ", 13.7, None), ("15", 15.0, None), ("_", None, "missing"),
        (None, None, "missing"), ("NaN", None, "missing"), ("not available", None, "not_a_number"),
        ("1,234", None, "thousands"), ("13,75", None, "thousands"), ("13.7,1", None, "ambiguous"), ("inf", None, "not_a_number"),
        ("1.0d", None, "not_a_number"), ("", None, "missing"), ("-", None, "missing"),
    ]
    df = spark.createDataFrame(cases, "c string, v double, why string")
    for r in df.select("*", names.parse_label(F.col("c")).alias("p")).collect():
        assert (r.p["value"], r.p["reason"]) == (r.v, r.why), r.c


def test_mask_names(spark):
    cases = [
        ("20200118_164733_forniceal", "forniceal"), ("20200118_164733_palpebral", "palpebral"),
        ("20200118_164733_forniceal_palpebral", "forniceal_palpebral"), ("001_palpebral", "palpebral"),
        ("20200124_202947_palpebral(1)", "palpebral"), ("20200124_202058_papebral", "palpebral"),
        ("T_64_20190612_092742_palplebral", "palpebral"), ("T_64_20190612_092742_forniceal_palplebral", "forniceal_palpebral"),
        ("20200118_164733", None), ("1", None), ("IMG_forniceaI", "forniceal"), ("x_forniceal_palpebra", "forniceal_palpebral"),
        ("forniceal_palp_ebral", "forniceal_palpebral"),
    ]
    df = spark.createDataFrame(cases, "s string, want string")
    for r in df.select("*", names.mask_roi(F.col("s")).alias("got")).collect():
        assert r.got == r.want, r.s


def test_withdrawn_and_keys(spark):
    df = spark.createDataFrame([("007", "x", "Removed by site"), ("0", "ELIMINATO", None), ("A1", None, None)], "n string, a string, b string")
    got = df.select(names.number_key(F.col("n")).alias("k"), names.withdrawn(["a", "b"]).alias("w")).collect()
    assert [r.k for r in got] == ["7", "0", "A1"]
    assert [(r.w and (r.w["marker"], r.w["column"])) for r in got] == [("removed", "b"), ("eliminato", "a"), None]


def test_agreement_pair(spark):
    t, p = np.array(TRUTH), np.array(PRED)
    row = A.agreement(pairs(spark, TRUTH, PRED)).first()
    d = p - t
    assert row.n == 12
    assert row.mae == pytest.approx(np.abs(d).mean(), abs=1e-12)
    assert row.rmse == pytest.approx(math.sqrt((d**2).mean()), abs=1e-12)
    assert row.r2 == pytest.approx(1 - (d**2).sum() / ((t - t.mean()) ** 2).sum(), abs=1e-12)
    assert row.explained_variance == pytest.approx(1 - d.var() / t.var(), abs=1e-12)
    assert row.pearson_r == pytest.approx(np.corrcoef(t, p)[0, 1], abs=1e-12)
    assert row.loa_upper == pytest.approx(d.mean() + 1.96 * d.std(ddof=1), abs=1e-12)
    assert row.proportional_slope == pytest.approx(np.polyfit((t + p) / 2, d, 1)[0], abs=1e-10)


def test_undefined_is_null(spark):
    flat = A.agreement(pairs(spark, [12.0, 12.0, 12.0], [11.0, 12.0, 13.0])).first()
    assert flat.r2 is None and flat.pearson_r is None and flat.explained_variance is None
    one = A.agreement(pairs(spark, [12.0, float("nan"), 3.0], [11.0, 1.0, float("inf")])).first()
    assert one.n == 1 and one.sd_diff == 0.0 and one.proportional_slope is None
    counts = finite_summary(pairs(spark, [12.0, float("nan"), 3.0], [11.0, 1.0, float("inf")]), "y_true", "y_pred").first()
    assert (counts.n_kept, counts.n_dropped, counts.enough) == (1, 2, False)


def test_small_subgroups_keep_their_row(spark):
    rows = [("a", 10.0, 11.0)] * 6 + [("b", 10.0, 12.0)] * 2
    df = spark.createDataFrame(rows, "g string, y_true double, y_pred double")
    got = {r.g: r for r in A.subgroup_table(df, ["g"]).collect()}
    assert got["b"].n == 2 and got["b"].mae is None and got["b"].verdict == "underpowered"
    assert got["a"].mae == 1.0 and got["a"].n_positive == 6


def test_confusion(spark):
    df = pairs(spark, [10.0, 11.0, 13.0, 14.0], [10.5, 12.5, 11.9, 14.0])
    r = S.threshold_metrics(df, F.lit(12.0)).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (1, 1, 1, 1)
    assert (r.sensitivity, r.specificity, r.ppv, r.npv) == (0.5, 0.5, 0.5, 0.5)
    assert r.verdict == "underpowered"
    edge = S.threshold_metrics(pairs(spark, [12.0], [12.0]), F.lit(12.0)).first()
    assert edge.tn == 1 and edge.sensitivity is None
    many = S.threshold_metrics(pairs(spark, [13.0] * 30, [13.0] * 30), F.lit(12.0)).first()
    assert many.verdict == "not_computable"
    none = S.threshold_metrics(pairs(spark, [float("nan")], [1.0]), F.lit(12.0)).first()
    assert none.n == 0 and none.verdict == "not_computable"


@pytest.mark.parametrize(
    "conf, hits, n, ece", [(0.5, 5, 10, 0.0), (0.9, 3, 4, 0.15), (1.0, 3, 4, 0.25), (1.0, 0, 8, 1.0)]
)
def test_calibration_error(spark, conf, hits, n, ece):
    df = spark.createDataFrame([(conf, i < hits) for i in range(n)], "c double, h boolean")
    assert C.calibration_error(C.reliability(df, "c", "h")).first().ece == pytest.approx(ece, abs=1e-12)
    if (conf, n) == (0.9, 4):
        assert C.brier(df, "c", "h").first().brier == pytest.approx(0.21, abs=1e-12)


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,), (0.7,)], "c double")
    got = [r[0] for r in df.select(gates.bin_index(F.col("c"))).collect()]
    want = [int(np.clip(np.digitize(v, np.linspace(0, 1, 11)[1:-1]), 0, 9)) for v in (0.3, 0.30000000000000004, 1.0, 0.0, 0.7)]
    assert got == want and got[0] == 2


def test_single_site_has_no_gap(spark):
    df = spark.createDataFrame([("a", 0.5, True), ("a", 0.7, False)], "s string, c double, h boolean")
    assert all(r.max_ece_gap is None for r in C.site_calibration(df, "c", "h", "s").collect())


def test_temperature_refuses_other_input(spark):
    with pytest.raises(TypeError):
        C.temperature_scale(spark.range(3), "z", "y", 4)


def test_temperature_is_recovered(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(4000, 4)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = [int(rng.choice(4, p=row)) for row in p]
    df = spark.createDataFrame([(row.tolist(), k, "val") for row, k in zip(z * 2.0, y)], "z array<double>, y int, split string")
    r = C.temperature_scale(C.ValidationSplit.of(df), "z", "y", 4).first()
    assert 1.6 < r.temperature < 2.5 and r.ece_after < r.ece_before


def test_risk_coverage_example(spark):
    # Ten rows, one large error in the middle of the order, four exact ones before it.
    err = [0, 0, 0, 0, 9.0, 0, 0, 0, 0, 0]
    rows = [(i, float(i), 0.0, float(e)) for i, e in enumerate(err)]
    df = spark.createDataFrame(rows, "id long, u double, y_true double, y_pred double")
    curve = V.risk_coverage(df, "u", "id", n_points=10).orderBy("point").collect()
    want = [0.9, 1.0, 1.125, 9 / 7, 1.5, 1.8, 0, 0, 0, 0]
    assert [r.coverage for r in curve] == pytest.approx([1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1])
    assert [r.mae for r in curve] == pytest.approx(want)
    assert curve[-1].threshold == 0.0


def test_empty_curve_threshold(spark):
    empty = spark.createDataFrame([], "point int, coverage double, threshold double")
    assert V.abstention_threshold(empty).first().threshold == float("inf")


def test_t_table():
    table = {1: 12.706, 5: 2.571, 10: 2.228, 20: 2.086, 60: 2.000, 120: 1.980}
    got = critical_value(0.95, np.array(list(table)))
    assert got == pytest.approx(list(table.values()), abs=6e-4)
    assert critical_value(0.99, np.array([10, 30])) == pytest.approx([3.169, 2.750], abs=6e-4)
    assert two_sided_p(np.array([2.228, 0.0]), np.array([10, 10])) == pytest.approx([0.05, 1.0], abs=2e-4)
    assert critical_value(0.95, np.array([1e9]))[0] == pytest.approx(1.959964, abs=1e-5)


def test_slope_gate(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-40, 60, 200).tolist()
    rows = [("steep", 10.0, 10.0 + 0.02 * a + e, a) for a, e in zip(x, rng.normal(0, 0.1, 200).tolist())]
    rows += [("none", 10.0, 10.0 + e, a) for a, e in zip(x, rng.normal(0, 0.1, 200).tolist())]
    rows += [("few", 10.0, 10.0 + 0.02 * a, a) for a in x[:10]]
    rows += [("flat", 10.0, 10.5 + 0.1 * i, 5.0) for i in range(30)]
    rows += [("two", 10.0, 11.0, 1.0), ("two", 10.0, 11.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, y_true double, y_pred double, ita double")
    got = {r.g: r for r in E.bias_slope(df, "ita", by=["g"]).collect()}
    assert got["steep"].verdict == "supported" and got["none"].verdict == "not_supported"
    assert got["few"].verdict == "underpowered" and got["two"].slope is None
    assert got["flat"].slope == 0.0 and got["flat"].p_value == 1.0 and got["flat"].verdict == "not_supported"
    assert got["steep"].p_value < 1e-10


def test_lab_values(spark):
    want = {
        (255, 0, 0): (53.241, 80.092, 67.203), (0, 255, 0): (87.735, -86.183, 83.179), (0, 0, 255): (32.297, 79.188, -107.860),
        (255, 255, 0): (97.137, -21.554, 94.478), (255, 255, 255): (100, 0, 0), (0, 0, 0): (0, 0, 0), (128, 128, 128): (53.585, 0, 0),
    }
    df = colour.with_lab(spark.createDataFrame(list(want), "r int, g int, b int"))
    for r in df.collect():
        assert (r.lab_l, r.lab_a, r.lab_b) == pytest.approx(want[(r.r, r.g, r.b)], abs=0.02)


def test_hsv_values(spark):
    want = {(255, 0, 0): (0, 255, 255), (0, 255, 0): (60, 255, 255), (0, 0, 255): (120, 255, 255), (128, 128, 128): (0, 0, 128), (255, 0, 255): (150, 255, 255), (0, 0, 0): (0, 0, 0)}
    for r in colour.with_hsv(spark.createDataFrame(list(want), "r int, g int, b int")).collect():
        assert (r.hsv_h, r.hsv_s, r.hsv_v) == want[(r.r, r.g, r.b)]


def test_pigment(spark):
    df = spark.createDataFrame([(100.0, 0.0), (50.0, 0.0), (20.0, 0.0)], "l double, b double")
    assert [r[0] for r in df.select(pigment.ita_angle(F.col("l"), F.col("b"))).collect()] == pytest.approx([90, 0, -90])
    bands = spark.createDataFrame([(55.0,), (54.9,), (10.0,), (-30.0,), (-30.1,), (None,), (float("nan"),)], "a double")
    assert [r[0] for r in bands.select(pigment.ita_band(F.col("a"))).collect()] == [
        "very_light", "light", "tan", "brown", "dark", "unknown", "unknown"
    ]


def test_vectors(spark):
    df = spark.createDataFrame([(12.0, [0.0, 0.0, 0.0]), (5.0, [100.0, 0.0, -900.0])], "v double, z array<double>")
    got = prob.soft_label(prob.softmax(df, "z", "p"), "v", "w").collect()
    assert got[0].p == pytest.approx([1 / 3] * 3) and got[1].p[0] == pytest.approx(1.0)
    for r in got:
        e = np.exp(-0.5 * ((r.v - np.array(BIN_CENTRES)) / 0.6) ** 2)
        assert r.w == pytest.approx((e / e.sum()).tolist(), abs=1e-12)
    zero = spark.createDataFrame([([0.0, 0.0],)], "p array<double>").select(prob.expected_value("p", [1.0, 2.0]))
    assert zero.first()[0] is None


def test_aliases(spark):
    df = spark.createDataFrame([("1", "12,5", "M")], ["Number", "Hb (g/dL)", "Gender"])
    with pytest.raises(ValueError):
        rename_by_alias(df.drop("Hb (g/dL)"), names.LABEL_ALIASES, ["hb"])
    named = rename_by_alias(df.withColumnRenamed("Hb (g/dL)", "HB_gdl"), names.LABEL_ALIASES, ["hb", "patient_id"])
    assert named.columns == ["patient_id", "hb", "sex"]
