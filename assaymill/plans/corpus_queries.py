"""Splits, integrity, corpus assembly and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import SEVERITY_CLASSES
from assaymill.functions import names
from assaymill.functions.who import severity_band, severity_index
from assaymill.operators import checks as K
from assaymill.operators import clean
from assaymill.operators import corpus as C
from assaymill.operators import integrity as I
from assaymill.operators import splits as S
from assaymill.operators import training as T
from assaymill.plans.registry import published, query, r
from assaymill.plans.views import FEATURES, LABELS, LISTING, PATIENTS

P = f"({PATIENTS.sql()})"
REGION_SITES = [f"NATION_{i}" for i in range(25)]
BAND = """CASE WHEN value < 7 THEN 'severe' WHEN value < 9 THEN 'moderate'
 WHEN value < CASE WHEN sex = 'M' THEN 13 ELSE 12 END THEN 'mild' ELSE 'normal' END"""


def _banded(spark: SparkSession, sf: str) -> DataFrame:
    return PATIENTS.frame(spark, sf).withColumn("band", severity_band(F.col("value"), F.col("sex")))


# --- splits -------------------------------------------------------------------


def _kfold_sql(part: str) -> str:
    over = f"PARTITION BY {part}" if part else ""
    return f"""WITH o AS (SELECT patient_id, row_number() OVER ({over} ORDER BY md5('42|' || patient_id), patient_id) - 1 AS place,
     count(*) OVER ({over}) AS n FROM (SELECT *, {BAND} AS band FROM {P})),
     b AS (SELECT *, fold*n//5 AS a, (fold+1)*n//5 AS z FROM o, range(5) f(fold)),
     i AS (SELECT *, CASE WHEN place < a THEN place ELSE place - (z-a) END AS idx, n-(z-a) AS rest FROM b)
     SELECT cast(fold AS INTEGER) AS fold, patient_id, CASE WHEN place >= a AND place < z THEN 'test'
     WHEN idx < greatest(1, round_even(rest*0.2e0, 0)) THEN 'val' ELSE 'train' END AS split FROM i"""


@query("kfold_plain", "W9 J4", _kfold_sql(""))
def kfold_plain(spark: SparkSession, sf: str) -> DataFrame:
    return S.kfold(PATIENTS.frame(spark, sf), "patient_id")


@query(
    "kfold_patients",
    "J4: folds joined to the patients they assign",
    f"""SELECT fold, split, site, count(*) AS n, count(value) AS n_value, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths, {r('min(value)', 'least')}, {r('max(value)', 'most')}
    FROM ({_kfold_sql("")}) JOIN {P} USING (patient_id) GROUP BY fold, split, site""",
)
def kfold_patients(spark: SparkSession, sf: str) -> DataFrame:
    people = PATIENTS.frame(spark, sf)
    joined = S.with_records(S.kfold(people, "patient_id"), people, "patient_id")
    return published(
        joined.groupBy("fold", "split", "site").agg(
            F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"), F.min("value").alias("least"), F.max("value").alias("most")
        )
    )


@query("kfold_stratified", "W9: blocks inside every severity band", _kfold_sql("band"))
def kfold_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return S.kfold(_banded(spark, sf), "patient_id", strata=["band"])


STRATIFIED = f"""WITH o AS (SELECT patient_id, {BAND} AS band FROM {P}),
 s AS (SELECT band, row_number() OVER (ORDER BY band) - 1 AS num, count(*) OVER () AS k FROM (SELECT DISTINCT band FROM o)),
 p AS (SELECT o.*, num, k, count(*) OVER () AS n,
       row_number() OVER (PARTITION BY band ORDER BY md5('42|' || patient_id), patient_id) - 1 AS place FROM o JOIN s USING (band)),
 t AS (SELECT *, place*k + num AS turn FROM p),
 a AS (SELECT *, row_number() OVER (ORDER BY turn) - 1 AS ahead, greatest(1, round_even(n*0.2e0, 0)) AS q FROM t)
 SELECT patient_id, band, CASE WHEN turn >= n THEN 'train' WHEN ahead < q THEN 'val' WHEN ahead < 2*q THEN 'test'
 ELSE 'train' END AS split FROM a"""


@query("stratified_split", "W10", STRATIFIED)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_split(_banded(spark, sf), "patient_id", "band")


def _sites(people: DataFrame) -> list[str]:
    return sorted(row["site"] for row in people.select("site").where("site IS NOT NULL").distinct().collect())


@query(
    "site_holdout_folds",
    "W11 X8",
    f"""WITH g AS (SELECT site, count(*) AS n FROM {P} GROUP BY site)
    SELECT concat(a.site, '->', b.site) AS fold, a.n AS n_train, b.n AS n_test FROM g a JOIN g b ON a.site <> b.site""",
)
def site_holdout_folds(spark: SparkSession, sf: str) -> DataFrame:
    people = PATIENTS.frame(spark, sf)
    return S.holdout_sizes(people, "site", _sites(people))


@query(
    "site_holdout_rows",
    "W11: every record in every fold of every ordered pair of sites",
    f"""WITH s AS (SELECT DISTINCT site FROM {P} WHERE site IS NOT NULL)
    SELECT concat(a.site, '->', b.site) AS fold, p.patient_id, CASE WHEN p.site = a.site THEN 'train' ELSE 'test' END AS split
    FROM s a JOIN s b ON a.site <> b.site JOIN {P} p ON p.site IN (a.site, b.site)""",
)
def site_holdout_rows(spark: SparkSession, sf: str) -> DataFrame:
    people = PATIENTS.frame(spark, sf)
    return S.site_holdout(people, "patient_id", "site", _sites(people))


@query(
    "site_holdout_rejects",
    "W11: rows a holdout would lose",
    f"""SELECT patient_id, CASE WHEN s IS NULL THEN 'missing' WHEN trim(s) = '' THEN 'blank' ELSE 'unlisted' END AS reason
    FROM (SELECT patient_id, CASE WHEN key % 10 = 3 THEN NULL WHEN key % 10 = 4 THEN '  ' WHEN key % 10 = 5 THEN 'ELSEWHERE' ELSE site END AS s
    FROM {P}) WHERE s IS NULL OR trim(s) = '' OR s = 'ELSEWHERE'""",
)
def site_holdout_rejects(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("key") % 10
    df = PATIENTS.frame(spark, sf).withColumn("site", F.when(k == 3, F.lit(None)).when(k == 4, "  ").when(k == 5, "ELSEWHERE").otherwise(F.col("site")))
    return S.without_site(df, "patient_id", "site", REGION_SITES)


# --- integrity ----------------------------------------------------------------

# An assignment with planted faults: some ids in two splits, some twice in one.
FAULTY = f"""SELECT key % 3 AS fold, patient_id, CASE WHEN key % 5 = 0 THEN 'test' WHEN key % 5 = 1 THEN 'val' ELSE 'train' END AS split
 FROM {P} UNION ALL SELECT key % 3, patient_id, 'test' FROM {P} WHERE key % 31 = 0
 UNION ALL SELECT key % 3, patient_id, 'train' FROM {P} WHERE key % 37 = 2"""


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    df = PATIENTS.frame(spark, sf)
    k = F.col("key")
    split = F.when(k % 5 == 0, "test").when(k % 5 == 1, "val").otherwise("train")
    base = df.select((k % 3).alias("fold"), "patient_id", split.alias("split"))
    more = df.where(k % 31 == 0).select((k % 3).alias("fold"), "patient_id", F.lit("test").alias("split"))
    again = df.where(k % 37 == 2).select((k % 3).alias("fold"), "patient_id", F.lit("train").alias("split"))
    return base.unionByName(more).unionByName(again)


LEAKS = f"""SELECT fold, patient_id, count(*) AS n_rows, string_agg(DISTINCT split, ',' ORDER BY split) AS splits,
 CASE WHEN count(DISTINCT split) > 1 THEN 'overlap' ELSE 'repeat' END AS kind FROM ({FAULTY})
 GROUP BY fold, patient_id HAVING count(*) > 1"""


@query("split_leakage", "X1", LEAKS)
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return I.split_leakage(_faulty(spark, sf), "patient_id")


@query(
    "split_overlap",
    "X1: pairwise intersection",
    f"SELECT patient_id FROM ({FAULTY}) WHERE split = 'train' INTERSECT SELECT patient_id FROM ({FAULTY}) WHERE split = 'test'",
)
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return I.split_overlap(_faulty(spark, sf), "patient_id", "train", "test")


@query(
    "first_offenders",
    "O3",
    f"""WITH l AS ({LEAKS}), r AS (SELECT kind, patient_id, row_number() OVER (PARTITION BY kind ORDER BY patient_id) AS rn,
    count(*) OVER (PARTITION BY kind) AS n FROM l) SELECT kind, any_value(n) AS n,
    string_agg(patient_id, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS first FROM r GROUP BY kind""",
)
def first_offenders(spark: SparkSession, sf: str) -> DataFrame:
    return I.first_offenders(split_leakage(spark, sf), ["kind"], "patient_id")


@query(
    "file_leakage",
    "X2",
    f"""SELECT path, min(split) AS first_split, max(split) AS last_split FROM (SELECT path, split FROM
    (SELECT DISTINCT patient_id, split FROM ({FAULTY})) JOIN
    (SELECT patient_id, concat(site, '/', cast(cast(floor(key / 100) as int) as string), '.png') AS path FROM {P}) USING (patient_id))
    GROUP BY path HAVING min(split) <> max(split)""",
)
def file_leakage(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("site", F.lit("/"), F.floor(F.col("key") / 100).cast("string"), F.lit(".png"))
    files = PATIENTS.frame(spark, sf).select("patient_id", path.alias("path"))
    return I.file_leakage(_faulty(spark, sf), files, "patient_id", "path")


@query(
    "id_set_equality",
    "X3 J7",
    f"""WITH a AS (SELECT patient_id FROM {P} WHERE key % 9 <> 0), b AS (SELECT patient_id FROM {P} WHERE key % 8 <> 0)
    SELECT count(*) FILTER (WHERE a.patient_id = b.patient_id) AS in_both, count(*) FILTER (WHERE b.patient_id IS NULL) AS only_left,
    count(*) FILTER (WHERE a.patient_id IS NULL) AS only_right, false AS equal FROM a FULL JOIN b ON a.patient_id = b.patient_id""",
)
def id_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    df = PATIENTS.frame(spark, sf)
    return I.id_sets(df.where("key % 9 <> 0"), df.where("key % 8 <> 0"), "patient_id")


@query(
    "subset_by_id",
    "J5: semi join, and the ids without a row",
    f"""SELECT 'found' AS part, site, count(*) AS n FROM {P} WHERE key % 4 = 0 AND key % 3 <> 0 GROUP BY site
    UNION ALL SELECT 'missing', site, count(*) FROM {P} WHERE key % 4 = 0 AND key % 3 = 0 GROUP BY site""",
)
def subset_by_id(spark: SparkSession, sf: str) -> DataFrame:
    df = PATIENTS.frame(spark, sf)
    ids, have = df.where("key % 4 = 0"), df.where("key % 3 <> 0")
    site = F.substring_index("patient_id", "/", 1).alias("site")
    found = I.subset(have, ids, "patient_id").select(F.lit("found").alias("part"), "site")
    lost = I.missing(have, ids, "patient_id").select(F.lit("missing").alias("part"), site)
    return found.unionByName(lost).groupBy("part", "site").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_of_keys",
    "X4 S8",
    f"""SELECT site, count(*) AS n, cast(NULL AS DOUBLE) AS mean, 'size' AS kind FROM {P} GROUP BY site
    UNION ALL SELECT site, NULL, round(avg(value), 6), 'value' FROM {P} GROUP BY site""",
)
def union_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    df = PATIENTS.frame(spark, sf)
    a = df.groupBy("site").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("size"))
    b = df.groupBy("site").agg(F.round(F.avg("value"), 6).alias("mean")).withColumn("kind", F.lit("value"))
    return I.union_of_keys(a, b)


@query(
    "unexpected_values",
    "X5",
    f"SELECT sex, count(*) AS n FROM {P} WHERE sex NOT IN ('M', 'F') GROUP BY sex",
)
def unexpected_values(spark: SparkSession, sf: str) -> DataFrame:
    return I.unexpected_values(PATIENTS.frame(spark, sf), "sex", ["M", "F"])


@query(
    "predictions_with_attributes",
    "J3 S9: per-patient prediction rows by id",
    f"""SELECT patient_id, site, sex, age, value AS hb_true, {r('value + 0.1e0*(o.n % 7) - 0.3e0', 'hb_pred', 4)},
    {r('0.1e0*(o.n % 7) - 0.3e0', 'error', 4)}, {BAND} AS severity
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o JOIN {P} p ON o.o_custkey = p.key""",
)
def predictions_with_attributes(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.plans.views import table
    from assaymill.sources.predictions import with_attributes

    shift = (F.lit(0.1) * (F.col("n") % 7) - 0.3).alias("shift")
    scored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    people = PATIENTS.frame(spark, sf)
    ids = people.select("key", "patient_id", "value")
    preds = scored.select("key", shift).join(ids, "key").select("patient_id", (F.col("value") + F.col("shift")).alias("y_pred"))
    return with_attributes(preds, people.withColumnRenamed("value", "y_true"))


# --- training tables ----------------------------------------------------------

FT = f"({FEATURES.sql()})"
TRAIN = f"(SELECT *, {BAND.replace('value', 'y')} AS band FROM {FT} WHERE split = 'train')"


@query(
    "class_centres",
    "A32",
    f"""WITH c(klass, band) AS (VALUES (0, 'normal'), (1, 'mild'), (2, 'moderate'), (3, 'severe'))
    SELECT klass, {r(f'coalesce(avg(y), (SELECT avg(y) FROM {TRAIN}))', 'centre')}
    FROM c LEFT JOIN {TRAIN} USING (band) GROUP BY klass""",
)
def class_centres(spark: SparkSession, sf: str) -> DataFrame:
    train = FEATURES.frame(spark, sf).where("split = 'train'")
    idx = severity_index(severity_band(F.col("y"), F.col("sex")))
    return published(T.class_centres(train, idx, "y", len(SEVERITY_CLASSES)))


WEIGHTS = f"""WITH c(klass, band) AS (VALUES (0, 'normal'), (1, 'mild'), (2, 'moderate'), (3, 'severe')),
 n AS (SELECT klass, count(t.band) AS n FROM c LEFT JOIN {TRAIN} t USING (band) GROUP BY klass),
 f AS (SELECT *, n/(SELECT cast(sum(n) AS DOUBLE) FROM n) AS f FROM n),
 w AS (SELECT *, CASE WHEN n > 0 THEN 1/(f+1e-6) ELSE 1.0e0 END AS w FROM f),
 weights AS (SELECT klass, n, w/(SELECT sum(f*w) FROM w) AS weight FROM w)"""


@query("class_weights", "A33", f"{WEIGHTS} SELECT klass, n, {r('weight', 'weight')} FROM weights")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    train = FEATURES.frame(spark, sf).where("split = 'train'")
    idx = severity_index(severity_band(F.col("y"), F.col("sex")))
    return published(T.class_weights(train, idx, len(SEVERITY_CLASSES)))


COLUMNS = [f"f{i}" for i in range(1, 14)]


def _standard_sql(columns: list[str], digits: int = 6) -> str:
    parts = ", ".join(
        f"round(CASE WHEN {c} IS NULL THEN NULL WHEN s.s_{c} > 1e-12 THEN ({c} - s.m_{c})/s.s_{c} ELSE 0 END, {digits}) + 0.0e0 AS {c}"
        for c in columns
    )
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    return f"SELECT id, {parts} FROM {FT}, (SELECT {stats} FROM {FT} WHERE split = 'train') s"


@query("standardise", "A35", _standard_sql(COLUMNS))
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    return published(T.standardise(FEATURES.frame(spark, sf), COLUMNS).select("id", *COLUMNS))


@query(
    "hybrid_features",
    "L0",
    f"""SELECT id, 10 AS dim, round(f1 + f2 + f3 + f4 + f6, 5) + 0.0e0 AS deep_sum,
    round(f7 + f8 + f9 + f10 + f12, 5) + 0.0e0 AS colour_sum
    FROM ({_standard_sql([c for c in COLUMNS if c not in ('f5', 'f11', 'f13')], 12)})""",
)
def hybrid_features(spark: SparkSession, sf: str) -> DataFrame:
    blocks = {"deep": ["f1", "f2", "f3", "f4", "f6"], "colour": ["f7", "f8", "f9", "f10", "f12"]}
    df = T.hybrid(FEATURES.frame(spark, sf), blocks)
    v = F.col("features")
    return df.select(
        "id",
        F.size("features").alias("dim"),
        (F.round(v[0] + v[1] + v[2] + v[3] + v[4], 5) + 0.0).alias("deep_sum"),
        (F.round(v[5] + v[6] + v[7] + v[8] + v[9], 5) + 0.0).alias("colour_sum"),
    )


@query(
    "non_finite_gate",
    "F14",
    f"""SELECT split, 'f5' AS "column", count(*) AS n_bad FROM {FT} WHERE f5 IS NULL GROUP BY split""",
)
def non_finite_gate(spark: SparkSession, sf: str) -> DataFrame:
    return clean.non_finite_gate(FEATURES.frame(spark, sf), COLUMNS, ["split"])


NOT_FINITE = " UNION ALL ".join(f"SELECT split, '{c}' AS \"column\", id FROM {FT} WHERE {c} IS NULL OR isnan({c}) OR isinf({c})" for c in COLUMNS)


@query(
    "non_finite_offenders",
    "F14 O3: the first eight ids of every column and split that is not finite",
    f"""SELECT split, "column", any_value(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 8) AS first
    FROM (SELECT *, row_number() OVER (PARTITION BY split, "column" ORDER BY id) AS rn, count(*) OVER (PARTITION BY split, "column") AS n FROM ({NOT_FINITE}))
    GROUP BY split, "column\"""",
)
def non_finite_offenders(spark: SparkSession, sf: str) -> DataFrame:
    bad = clean.non_finite_rows(FEATURES.frame(spark, sf), COLUMNS, ["split"], "id")
    return I.first_offenders(bad, ["split", "column"], "id", 8)


@query(
    "leak_offenders",
    "X1 X2 O3: the first eight leaking ids of every fold and kind, the first eight paths of every pair of splits",
    f"""WITH l AS (SELECT 'id' AS what, concat(kind, ' in fold ', CAST(fold AS VARCHAR)) AS "where", patient_id AS item FROM ({LEAKS})
     UNION ALL SELECT 'path', concat(min(split), ' and ', max(split)), path FROM (SELECT path, split FROM
      (SELECT DISTINCT patient_id, split FROM ({FAULTY})) JOIN
      (SELECT patient_id, concat(site, '/', cast(cast(floor(key / 100) as int) as string), '.png') AS path FROM {P}) USING (patient_id))
     GROUP BY path HAVING min(split) <> max(split))
    SELECT what, "where", any_value(n) AS n, string_agg(item, ',' ORDER BY rn) FILTER (WHERE rn <= 8) AS first
    FROM (SELECT *, row_number() OVER (PARTITION BY what, "where" ORDER BY item) AS rn, count(*) OVER (PARTITION BY what, "where") AS n FROM l) GROUP BY what, "where\"""",
)
def leak_offenders(spark: SparkSession, sf: str) -> DataFrame:
    ids = split_leakage(spark, sf).select(F.lit("id").alias("what"), F.concat("kind", F.lit(" in fold "), F.col("fold").cast("string")).alias("where"), F.col("patient_id").alias("item"))
    paths = file_leakage(spark, sf).select(F.lit("path").alias("what"), F.concat("first_split", F.lit(" and "), "last_split").alias("where"), F.col("path").alias("item"))
    return I.first_offenders(ids.unionByName(paths), ["what", "where"], "item", 8)


@query(
    "model_ready_columns",
    "F13 F16: undefined column dropped, numbers rounded, text kept",
    f"""SELECT id + 0.0e0 AS id, site, sex, split, round(y, 4) + 0.0e0 AS y,
    {', '.join(f'round({c}, 4) + 0.0e0 AS {c}' for c in COLUMNS if c != 'f5')} FROM {FT}""",
)
def model_ready_columns(spark: SparkSession, sf: str) -> DataFrame:
    ready = clean.drop_undefined(clean.nan_to_null(FEATURES.frame(spark, sf)), ["f5"])
    return published(clean.rounded(ready, 4), 4)


@query(
    "head_losses",
    "A34",
    f"""{WEIGHTS}, z AS (SELECT id, sex, split, y, [f1, f2, f3, f4] AS z, f6 AS s FROM {FT}),
    t AS (SELECT *, {BAND.replace('value', 'y')} AS band, ln(exp(z[1])+exp(z[2])+exp(z[3])+exp(z[4])) AS norm FROM z),
    i AS (SELECT *, CASE band WHEN 'normal' THEN 1 WHEN 'mild' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END AS i,
      exp(-0.5e0*pow((y-13)/0.6e0,2)) AS g1, exp(-0.5e0*pow((y-11)/0.6e0,2)) AS g2,
      exp(-0.5e0*pow((y-8)/0.6e0,2)) AS g3, exp(-0.5e0*pow((y-6)/0.6e0,2)) AS g4 FROM t),
    l AS (SELECT split, z[i] - norm AS lp, weight, abs(y - 12 - s) AS d,
      -(g1*(z[1]-norm) + g2*(z[2]-norm) + g3*(z[3]-norm) + g4*(z[4]-norm))/(g1+g2+g3+g4) AS soft,
      greatest(s, 0) - s*(CASE WHEN y < 13 THEN 1 ELSE 0 END) + ln(1 + exp(-abs(s))) AS bce
      FROM i JOIN weights ON klass = i - 1),
    m AS (SELECT *, CASE WHEN d < 1 THEN 0.5e0*d*d ELSE d - 0.5e0 END AS h FROM l)
    SELECT split, {r('avg(h)', 'huber')}, {r('avg(soft)', 'soft_ce')}, {r('avg(-lp*weight)', 'weighted_ce')},
    {r('avg(bce*2)', 'weighted_bce')}, {r('avg(-pow(1-exp(lp), 2)*lp)', 'focal')},
    {r('avg(soft + 0.5e0*h)', 'multitask')} FROM m GROUP BY split""",
)
def head_losses(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.functions import prob

    df = FEATURES.frame(spark, sf)
    idx = severity_index(severity_band(F.col("y"), F.col("sex")))
    weights = T.class_weights(df.where("split = 'train'"), idx, 4)
    df = df.select("split", "y", F.array("f1", "f2", "f3", "f4").alias("z"), F.col("f6").alias("s"), idx.alias("k"))
    df = df.withColumn("w", T.weight_lookup(weights, F.col("k")))
    df = prob.soft_label(prob.log_softmax(df, "z", "lp"), "y", "target", centres=(13.0, 11.0, 8.0, 6.0))
    k, soft = F.col("k"), prob.soft_cross_entropy("lp", "target", 4)
    guess = F.col("s") + 12
    return published(
        df.groupBy("split").agg(
            F.avg(prob.smooth_l1(F.col("y"), guess)).alias("huber"),
            F.avg(soft).alias("soft_ce"),
            F.avg(prob.cross_entropy("lp", k, F.col("w"))).alias("weighted_ce"),
            F.avg(prob.binary_cross_entropy(F.col("s"), (F.col("y") < 13).cast("double"), F.lit(2.0))).alias("weighted_bce"),
            F.avg(prob.focal("lp", k)).alias("focal"),
            F.avg(prob.multitask(soft, F.col("y"), guess)).alias("multitask"),
        )
    )


# --- label cells and file names -----------------------------------------------

LB = f"({LABELS.sql()})"
NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MARK = ", ".join(f"'{m}'" for m in names.MISSING_MARKERS)
PARSED = f"""(SELECT *, CASE WHEN reason IS NULL THEN num END AS value FROM (SELECT *,
 CASE WHEN hb IS NULL OR lower(t) IN ({MARK}) THEN 'missing' WHEN contains(t, '.') AND contains(t, ',') THEN 'ambiguous'
 WHEN regexp_matches(t, '^[+-]*[0-9]+,[0-9]{{2,}}$') THEN 'thousands' WHEN num IS NULL OR isinf(num) THEN 'not_a_number' END AS reason
 FROM (SELECT *, trim(hb) AS t, CASE WHEN regexp_matches(replace(trim(hb), ',', '.'), '{NUM}')
 THEN try_cast(replace(trim(hb), ',', '.') AS DOUBLE) END AS num FROM {LB})))"""


def _marked(column: str) -> str:
    return " ".join(f"WHEN contains(lower({column}), '{m}') THEN '{m}|{column}'" for m in names.WITHDRAWN_MARKERS)


TEXT_COLUMNS = ["patient_id", "hb", "sex", "age", "site", "note", "flag"]
OUT = f"CASE {' '.join(_marked(c) for c in TEXT_COLUMNS)} END"
TYPED = f"""(SELECT CASE WHEN contains(lower(site), 'india') THEN 'India' WHEN contains(lower(site), 'ital') THEN 'Italy'
 ELSE 'unknown' END AS site, CASE WHEN regexp_matches(trim(patient_id), '^[0-9]+$') THEN
 cast(cast(trim(patient_id) AS BIGINT) AS VARCHAR) ELSE trim(patient_id) END AS number, round(value, 4) AS value, reason AS reject_reason,
 value BETWEEN 3 AND 25 AS in_range, CASE WHEN lower(trim(sex)) LIKE 'm%' THEN 'M' WHEN lower(trim(sex)) LIKE 'f%' THEN 'F'
 ELSE 'unknown' END AS sex, CASE WHEN regexp_matches(trim(age), '{NUM}') AND NOT coalesce(isinf(try_cast(age AS DOUBLE)), true) THEN try_cast(age AS DOUBLE) END AS age,
 coalesce(trim(note), '') AS note, split_part({OUT}, '|', 1) AS marker, split_part({OUT}, '|', 2) AS marker_column, row_pos
 FROM {PARSED})"""


@query("typed_labels", "S2 F3 F4 F5 F6 F7 F8 F9", f"SELECT * FROM {TYPED}")
def typed_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = C.typed_labels(LABELS.frame(spark, sf))
    return df.withColumn("value", F.round("value", 4)).withColumn("row_pos", F.col("row_pos").cast("long"))


SHEET_HEADERS = {
    "India": {"patient_id": "Number", "hb": "Hgb", "sex": "Gender", "age": "Age (years)", "note": "Remarks", "flag": "flag"},
    "Italy": {"patient_id": "Patient ID", "hb": "Hb (g/dL)", "sex": "Sex", "age": "AGE", "note": "Note", "flag": "flag"},
}


@query(
    "label_sheets_from_files",
    "S2 F1 F8: sheets with other headers, decimal numbers and no site column, read from files",
    f"""SELECT site, number, value, reject_reason, in_range, sex, age, note, marker, marker_column FROM {TYPED} WHERE site <> 'unknown'""",
)
def label_sheets_from_files(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.session import shared_folder
    from assaymill.sources.labels import read_sheets

    folder, df = shared_folder(spark), LABELS.frame(spark, sf)
    number = F.when(F.rlike(F.trim("patient_id"), F.lit("^[0-9]+$")), F.concat(F.trim("patient_id"), F.lit(".0"))).otherwise(F.col("patient_id"))
    paths = []
    for site, headers in SHEET_HEADERS.items():
        rows = df.where(names.normal_site(F.col("site")) == site).withColumn("patient_id", number)
        paths.append(f"{folder}/{site}_labels.csv")
        out = rows.select(*[F.col(c).alias(h) for c, h in headers.items()]).write.option("header", True).option("escape", '"')
        out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[-1])
    typed = C.typed_labels(read_sheets(spark, paths)).withColumn("value", F.round("value", 4))
    return typed.drop("row_pos")


LAST = f"""(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY site, number) AS n_rows,
 row_number() OVER (PARTITION BY site, number ORDER BY row_pos DESC) AS rn FROM {TYPED}) WHERE rn = 1)"""


@query(
    "last_label_row",
    "W8 O1",
    f"SELECT site, number, value, sex, age, row_pos, n_rows FROM {LAST}",
)
def last_label_row(spark: SparkSession, sf: str) -> DataFrame:
    df = C.last_rows(C.typed_labels(LABELS.frame(spark, sf)))
    return df.select("site", "number", F.round("value", 4).alias("value"), "sex", "age", "row_pos", "n_rows")


@query(
    "withdrawn_records",
    "F4",
    f"SELECT marker, marker_column, count(*) AS n FROM {TYPED} WHERE marker IS NOT NULL GROUP BY ALL",
)
def withdrawn_records(spark: SparkSession, sf: str) -> DataFrame:
    df = C.typed_labels(LABELS.frame(spark, sf)).where(F.col("marker").isNotNull())
    return df.groupBy("marker", "marker_column").agg(F.count(F.lit(1)).alias("n"))


FL = f"({LISTING.sql()})"
STEM = "regexp_replace(name, '\\.[^.]*$', '')"
PLAIN = f"regexp_replace(lower({STEM}), '\\([0-9]+\\)$', '')"


def roi_sql(plain: str) -> str:
    """Ending, known spelling of the last word, one edit; in that order."""
    tail = f"regexp_extract({plain}, '[^_]*$')"
    exact = " ".join(f"WHEN ends_with({plain}, '{x}') THEN '{x}'" for x in names.ROIS)
    typo = " ".join(f"WHEN {tail} = '{a}' THEN '{b}'" for a, b in names.ROI_TYPOS.items())
    edit = " ".join(f"WHEN length({tail}) > 3 AND levenshtein({tail}, '{x}') <= 1 THEN '{x}'" for x in names.ROIS)
    whole = " ".join(f"WHEN levenshtein({plain}, '{x}') <= 1 THEN '{x}'" for x in names.ROIS)
    fixed = f"(CASE {typo} {edit} END)"
    return f"""CASE {exact} WHEN {fixed} = 'palpebral' AND ends_with({plain}, 'forniceal_' || {tail}) THEN 'forniceal_palpebral'
     WHEN {fixed} IS NOT NULL THEN {fixed} {whole} END"""


CLASSED = f"""(SELECT *, CASE WHEN ext = 'png' THEN roi0 END AS roi, ext IN ('jpg','jpeg','png','bmp','tif','tiff') AS is_image,
 roi0 IS NULL AND ext IN ('jpg','jpeg','png','bmp','tif','tiff') AS is_photo FROM (SELECT *, {roi_sql(PLAIN)} AS roi0,
 lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM {FL}))"""


@query(
    "classified_files",
    "S3 M18 M19",
    f"SELECT name, roi, is_image, is_photo, count(*) AS n FROM {CLASSED} GROUP BY ALL",
)
def classified_files(spark: SparkSession, sf: str) -> DataFrame:
    return C.classified(LISTING.frame(spark, sf)).groupBy("name", "roi", "is_image", "is_photo").agg(
        F.count(F.lit(1)).alias("n")
    )


WORDS = f"(SELECT replace(p_name, ' ', '_') || '_' || substr('palpebralforniceal', 1 + p_partkey % 9, 9) AS s FROM part)"


@query(
    "fuzzy_mask_names",
    "M18 M19: one edit and the bound beyond it",
    f"""SELECT s, roi, levenshtein(s, 'palpebral') AS distance, count(*) AS n FROM
    (SELECT s, {roi_sql('s')} AS roi FROM {WORDS}) GROUP BY ALL""",
)
def fuzzy_mask_names(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.plans.views import table

    s = F.concat(
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.lit("_"),
        F.substring(F.lit("palpebralforniceal"), (1 + F.col("p_partkey") % 9).cast("int"), F.lit(9)),
    )
    df = table(spark, sf, "part").select(s.alias("s"))
    return (
        df.groupBy("s")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("s", names.mask_roi(F.col("s")).alias("roi"), F.levenshtein("s", F.lit("palpebral")).cast("long").alias("distance"), "n")
    )


def _mask_pick(roi: str) -> str:
    rank = f"(CASE WHEN regexp_matches({STEM}, '\\([0-9]+\\)$') THEN 1 ELSE 0 END, length(name), name)"
    return f"arg_min(path, {rank}) FILTER (WHERE roi = '{roi}')"


_MASKS = f"""(SELECT site, folder, roi, list({{'path': path, 'length': length, 'copied': CASE WHEN regexp_matches({STEM}, '\\([0-9]+\\)$') THEN 1 ELSE 0 END,
 'size': length(name), 'name': name, 'copies': 0}} ORDER BY name) AS m FROM {CLASSED} WHERE roi IS NOT NULL GROUP BY site, folder, roi)"""


@query(
    "collapsed_masks",
    "W6: copies of one region and size are one mask",
    f"""SELECT site, folder, roi, h.path AS path, h.length AS length, len(m) AS n_masks, h.copies AS n_copies FROM (SELECT *, list_reduce(m, lambda a, x:
    CASE WHEN x.length = a.length OR (x.copied, x.size, x.name) < (a.copied, a.size, a.name)
     THEN {{'path': x.path, 'length': x.length, 'copied': x.copied, 'size': x.size, 'name': x.name, 'copies': a.copies + CASE WHEN x.length = a.length THEN 1 ELSE 0 END}}
     ELSE {{'path': a.path, 'length': a.length, 'copied': a.copied, 'size': a.size, 'name': a.name, 'copies': a.copies}} END) AS h FROM {_MASKS})""",
)
def collapsed_masks(spark: SparkSession, sf: str) -> DataFrame:
    return C.collapsed_masks(LISTING.frame(spark, sf))


KEY = "CASE WHEN regexp_matches(folder, '^[0-9]+$') THEN cast(cast(folder AS BIGINT) AS VARCHAR) ELSE folder END"
FOLDERS = f"""(SELECT site, folder, {KEY} AS number, arg_min(path, name) FILTER (WHERE is_photo) AS image, count(*) AS n_files,
 {', '.join(f'{_mask_pick(x)} AS mask_{x}' for x in names.ROIS)} FROM {CLASSED} GROUP BY site, folder HAVING bool_or(is_image))"""


@query("patient_folders", "S3 J2 W6 W7 M23", f"SELECT * FROM {FOLDERS}")
def patient_folders(spark: SparkSession, sf: str) -> DataFrame:
    df = C.folders(LISTING.frame(spark, sf))
    return df.select(
        "site", "folder", "number", "image", "n_files", *[C.mask_of(F.col("masks"), x).alias(f"mask_{x}") for x in names.ROIS]
    )


RECORDS = f"""(SELECT f.site || '/' || folder AS patient_id, f.site, sex, age, value, image, mask_palpebral, mask_forniceal, note,
 CASE WHEN l.number IS NULL THEN 'no label row' WHEN marker <> '' THEN 'excluded' WHEN value IS NULL THEN 'no value'
 WHEN NOT in_range THEN 'out of range' WHEN image IS NULL THEN 'no image' WHEN mask_palpebral IS NULL THEN 'no mask' END AS drop_reason
 FROM {FOLDERS} f LEFT JOIN {LAST} l ON f.site = l.site AND f.number = l.number)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return C.build_records(C.typed_labels(LABELS.frame(spark, sf)), LISTING.frame(spark, sf), require_masks=True)


@query(
    "build_records",
    "F10 J1 J2 W6 W7 W8 O1",
    f"""SELECT patient_id, site, sex, age, value, image, mask_palpebral, note FROM {RECORDS} WHERE drop_reason IS NULL""",
)
def build_records(spark: SparkSession, sf: str) -> DataFrame:
    df = C.corpus_order(C.kept(_records(spark, sf)))
    return df.select(
        "patient_id", "site", "sex", "age", F.round("value", 4).alias("value"), "image",
        C.mask_of(F.col("masks")).alias("mask_palpebral"), "note",
    )


@query(
    "drop_report",
    "F10",
    f"SELECT site, coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM {RECORDS} GROUP BY ALL",
)
def drop_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_report(_records(spark, sf))


@query(
    "unmatched_labels",
    "J1: sheet rows without a folder",
    f"SELECT site, number, n_rows FROM {LAST} l WHERE NOT EXISTS (SELECT 1 FROM {FOLDERS} f WHERE f.site = l.site AND f.number = l.number)",
)
def unmatched_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = C.typed_labels(LABELS.frame(spark, sf))
    return C.unmatched_labels(labels, C.folders(LISTING.frame(spark, sf))).select("site", "number", "n_rows")


@query(
    "patients_lacking_roi",
    "J6",
    f"SELECT patient_id, site FROM {RECORDS} WHERE (drop_reason IS NULL OR drop_reason = 'no mask') AND mask_palpebral IS NULL",
)
def patients_lacking_roi(spark: SparkSession, sf: str) -> DataFrame:
    records = C.build_records(C.typed_labels(LABELS.frame(spark, sf)), LISTING.frame(spark, sf))
    return C.lacking_roi(C.kept(records), "palpebral")


@query(
    "corpus_kind",
    "F15",
    f"SELECT CASE WHEN bool_or(starts_with(name, 'SYNTHETIC_')) THEN 'synthetic' WHEN bool_or(site = 'India') AND bool_or(site = 'Italy')"
    f" THEN 'documented' ELSE 'unknown' END AS kind FROM {FL}",
)
def corpus_kind(spark: SparkSession, sf: str) -> DataFrame:
    return C.corpus_kind(LISTING.frame(spark, sf))


@query(
    "site_stats",
    "A36",
    f"""SELECT site, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, min(value) AS lowest,
    max(value) AS highest, {r('avg(age)', 'mean_age')},
    {r("100*avg(CASE WHEN value < CASE WHEN sex = 'M' THEN 13 ELSE 12 END THEN 1.0e0 ELSE 0.0e0 END)", 'prevalence_pct')},
    cast(count_if(sex = 'F') AS BIGINT) AS n_f, cast(count_if(sex = 'M') AS BIGINT) AS n_m,
    cast(count_if(sex = 'unknown') AS BIGINT) AS n_unknown FROM {P} GROUP BY site""",
)
def site_stats(spark: SparkSession, sf: str) -> DataFrame:
    return published(C.site_stats(PATIENTS.frame(spark, sf)))


@query(
    "band_histogram",
    "A37 J14",
    f"""WITH b(band) AS (VALUES ('normal'), ('mild'), ('moderate'), ('severe')),
    c AS (SELECT CASE WHEN value < 7 THEN 'moderate' ELSE {BAND} END AS band, count(*) AS n FROM {P} GROUP BY 1)
    SELECT band, coalesce(n, 0) AS n, {r('coalesce(100.0e0*n/(SELECT sum(n) FROM c), 0)', 'share_pct')}
    FROM b LEFT JOIN c USING (band)""",
)
def band_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return published(C.band_histogram(PATIENTS.frame(spark, sf).withColumn("value", F.greatest("value", F.lit(7.0)))))


# --- validation suite ---------------------------------------------------------

KEPT = f"(SELECT * FROM {RECORDS} WHERE drop_reason IS NULL)"


def _row(label: str, passed: str, detail: str, severity: str = "'OK'") -> str:
    return f"""SELECT '{label}' AS label, coalesce({passed}, false) AS passed,
     CASE WHEN NOT coalesce({passed}, false) THEN 'FAIL' ELSE {severity} END AS severity, cast({detail} AS VARCHAR) AS detail"""


CONTRACT = " UNION ALL ".join(
    [
        f"{_row('all 217 records load', 'count(*) = 217', 'count(*)')} FROM {KEPT}",
        f"{_row('India holds 95 records', 'count(*) = 95', 'count(*)')} FROM {KEPT} WHERE site = 'India'",
        f"{_row('Italy holds 122 records', 'count(*) = 122', 'count(*)')} FROM {KEPT} WHERE site = 'Italy'",
        f"{_row('mean of India is 11.47', 'abs(avg(value) - 11.47e0) < 0.02e0', 'round(avg(value), 3)')} FROM {KEPT} WHERE site = 'India'",
        f"{_row('mean of Italy is 13.83', 'abs(avg(value) - 13.83e0) < 0.02e0', 'round(avg(value), 3)')} FROM {KEPT} WHERE site = 'Italy'",
        f"{_row('Italy/93 is withdrawn', 'count(*) = 0', 'count(*)')} FROM {KEPT} WHERE patient_id = 'Italy/93'",
        f"{_row('ids are unique', 'max(c) <= 1', 'max(c)')} FROM (SELECT count(*) AS c FROM {KEPT} GROUP BY patient_id)",
        f"{_row('ids are site-qualified', 'count(*) = 0', 'count(*)')} FROM {KEPT} WHERE NOT contains(patient_id, '/')",
        f"{_row('every record has region palpebral', 'count(*) = 0', 'count(*)')} FROM {KEPT} WHERE mask_palpebral IS NULL",
    ]
)


@query("contract_checks", "X6", CONTRACT)
def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    return K.contract_checks(
        C.kept(_records(spark, sf)), {"India": 95, "Italy": 122}, {"India": 11.47, "Italy": 13.83}, "Italy/93", "palpebral"
    )


DOMAIN = " UNION ALL ".join(
    [
        f"{_row('every value lies in [3, 25]', 'count_if(NOT value BETWEEN 3 AND 25) = 0', 'count_if(NOT value BETWEEN 3 AND 25)')} FROM {P}",
        _row(
            "sex has a severity definition", "true", "count_if(sex NOT IN ('F', 'M'))",
            "CASE WHEN count_if(sex NOT IN ('F', 'M')) > 0 THEN 'WARN' ELSE 'OK' END",
        )
        + f" FROM {P}",
        f"{_row('site is known', 'count(*) = 0', 'count(*)')} FROM {P} WHERE site NOT LIKE 'NATION_%'",
    ]
)
BANDS = f"""SELECT 'severity band ' || band AS label, true AS passed, CASE WHEN n = 0 THEN 'WARN' ELSE 'OK' END AS severity,
 n || ' records' AS detail FROM (SELECT b.band, count(c.band) AS n FROM (VALUES ('normal'), ('mild'), ('moderate'), ('severe')) b(band)
 LEFT JOIN (SELECT {BAND} AS band FROM {P}) c ON b.band = c.band GROUP BY b.band)"""
HOLDOUT = f"""SELECT 'holdout ' || a || '->' || b || ' evaluates records' AS label, n > 0 AS passed,
 CASE WHEN n > 0 THEN 'OK' ELSE 'FAIL' END AS severity, cast(n AS VARCHAR) AS detail FROM (SELECT a, b, count(p.site) AS n FROM
 (SELECT x.site AS a, y.site AS b FROM (SELECT DISTINCT site FROM {P}) x JOIN (SELECT DISTINCT site FROM {P}) y ON x.site <> y.site) v
 LEFT JOIN {P} p ON p.site = v.b GROUP BY a, b)"""


def _suite(spark: SparkSession, sf: str) -> DataFrame:
    people = PATIENTS.frame(spark, sf)
    sizes = S.holdout_sizes(people, "site", _sites(people))
    return K.suite(K.domain_checks(people, REGION_SITES), K.band_checks(people), K.holdout_checks(sizes))


@query("validation_suite", "X7 X8 A37", f"{DOMAIN} UNION ALL {BANDS} UNION ALL {HOLDOUT}")
def validation_suite(spark: SparkSession, sf: str) -> DataFrame:
    return _suite(spark, sf)


@query(
    "validation_status",
    "X9",
    f"""SELECT count_if(severity = 'FAIL') = 0 AS passed, cast(count_if(severity = 'FAIL') AS BIGINT) AS n_fail,
    cast(count_if(severity = 'WARN') AS BIGINT) AS n_warn, cast(count_if(severity = 'OK') AS BIGINT) AS n_ok
    FROM ({DOMAIN} UNION ALL {BANDS} UNION ALL {HOLDOUT})""",
)
def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    return K.status(_suite(spark, sf))


@query(
    "duplicate_label_check",
    "X6 W8: numbers used twice in a sheet",
    f"""{_row('no number is used twice', 'true', 'count(*)', "CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END")}
    FROM (SELECT 1 FROM {TYPED} GROUP BY site, number HAVING count(*) > 1)""",
)
def duplicate_label_check(spark: SparkSession, sf: str) -> DataFrame:
    return K.duplicate_checks(C.typed_labels(LABELS.frame(spark, sf)))
