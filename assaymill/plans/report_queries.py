"""Sweep, head, report and store queries, and the whole audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, CONFOUND_NOTE
from assaymill.operators import agreement as A
from assaymill.operators import calibration as C
from assaymill.operators import sweep as W
from assaymill.operators import tables as B
from assaymill.operators import training as T
from assaymill.operators.clean import finite_rows
from assaymill.operators.integrity import union_of_keys
from assaymill.plans import agreement_queries as AQ
from assaymill.plans import score_queries as SQ
from assaymill.plans.evaluate import evaluate, long_form
from assaymill.plans.registry import published, query, r
from assaymill.plans.views import FEATURES, PRED, View
from assaymill.session import shared_folder, written
from assaymill.sources import feature_store, predictions, reports, sinks

P = f"({PRED.sql()})"
OK = AQ.OK

# --- candidates -----------------------------------------------------------------

# Every prediction belongs to one candidate; some combinations are not valid.
CANDIDATE = View(
    source="",
    parent=PRED,
    columns={
        "y_true": "y_true",
        "y_pred": "y_pred",
        "kind": "case when l_suppkey % 4 = 0 then 'deep' when l_suppkey % 4 = 1 then 'colour' when l_suppkey % 4 = 2 then 'hybrid'"
        " else case when l_suppkey % 7 = 1 then 'texture' else 'colour' end end",
        "roi": "case when l_suppkey % 3 = 0 then 'forniceal_palpebral' when l_suppkey % 3 = 1 then 'forniceal' else 'palpebral' end",
        "balance": "case when l_suppkey % 5 < 2 then 'raw' else 'balanced' end",
        "head": "head",
    },
)
CA = f"({CANDIDATE.sql()})"
REASON = """CASE WHEN kind NOT IN ('deep', 'colour', 'hybrid') THEN 'unknown kind' WHEN roi NOT IN ('forniceal_palpebral', 'forniceal', 'palpebral')
 THEN 'unknown roi' WHEN balance NOT IN ('balanced', 'raw') THEN 'unknown balance' WHEN kind = 'deep' AND balance <> 'balanced' THEN 'deep has no balance' END"""
LABEL = "CASE WHEN kind = 'deep' THEN kind || ' / ' || roi ELSE kind || ' / ' || roi || ' / ' || balance END"


def _val_rows(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    scored = A.agreement(CANDIDATE.frame(spark, sf), by=by)
    return scored.select(*by, F.col("n").alias("n_val"), F.col("mae").alias("val_mae"), F.col("r2").alias("val_r2"))


def _candidates(spark: SparkSession, sf: str, by: tuple[str, ...] = ("kind", "roi", "balance")) -> DataFrame:
    valid, _ = W.validated(_val_rows(spark, sf, list(by)))
    return W.labelled(valid)


SCORED = f"""(SELECT *, {LABEL} AS label, kind || '/' || roi || '/' || balance AS cache_key FROM (SELECT kind, roi, balance, count(*) AS n_val,
 avg(abs(y_pred-y_true)) AS val_mae, 1 - sum(pow(y_pred-y_true, 2))/regr_sxx(y_true, y_true) AS val_r2 FROM {CA}
 WHERE y_pred IS NOT NULL AND ({REASON}) IS NULL GROUP BY kind, roi, balance))"""


@query(
    "candidate_rejects",
    "F22",
    f"SELECT DISTINCT kind, roi, balance, {REASON} AS reason FROM {CA} WHERE ({REASON}) IS NOT NULL",
)
def candidate_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = W.validated(CANDIDATE.frame(spark, sf).select("kind", "roi", "balance").distinct())
    return bad


@query(
    "candidate_scores",
    "S11 M20 X11",
    f"SELECT label, cache_key, n_val, {r('val_mae', 'val_mae')}, {r('val_r2', 'val_r2')} FROM {SCORED}",
)
def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return published(_candidates(spark, sf).select("label", "cache_key", "n_val", "val_mae", "val_r2"))


@query(
    "grid_coverage",
    "X10: grid candidates with and without a score",
    f"""WITH g AS (SELECT kind, roi, balance FROM (VALUES ('deep'), ('colour'), ('hybrid')) k(kind), (VALUES ('forniceal_palpebral'), ('forniceal'), ('palpebral')) r(roi),
    (VALUES ('balanced'), ('raw')) b(balance) WHERE NOT (kind = 'deep' AND balance = 'raw'))
    SELECT g.kind, g.roi, g.balance, coalesce(n_val, 0) AS n_val FROM g LEFT JOIN {SCORED} s ON g.kind = s.kind AND g.roi = s.roi AND g.balance = s.balance""",
)
def grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    have = _candidates(spark, sf).select("kind", "roi", "balance", "n_val")
    out = W.grid(spark).join(have, ["kind", "roi", "balance"], "left")
    return out.select("kind", "roi", "balance", F.coalesce("n_val", F.lit(0)).alias("n_val"))


@query(
    "extraction_keys",
    "X11",
    f"SELECT DISTINCT kind || '/' || roi || '/' || balance AS cache_key FROM {CA} WHERE ({REASON}) IS NULL",
)
def extraction_keys(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = W.validated(CANDIDATE.frame(spark, sf).select("kind", "roi", "balance", "head"))
    return W.extraction_keys(valid)


TERMS = "(SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'deep/palpebral' WHEN 1 THEN ' colour / forniceal / raw ' WHEN 2 THEN 'hybrid/forniceal/balanced' ELSE 'deep/eyelid' END AS t FROM supplier)"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.plans.views import table

    k = F.col("s_suppkey") % 4
    term = (
        F.when(k == 0, "deep/palpebral").when(k == 1, " colour / forniceal / raw ").when(k == 2, "hybrid/forniceal/balanced").otherwise("deep/eyelid")
    )
    return table(spark, sf, "supplier").select(term.alias("term"))


@query(
    "candidate_filter",
    "F21",
    f"""SELECT 'chosen' AS part, label AS item FROM {SCORED} WHERE EXISTS (SELECT 1 FROM {TERMS} WHERE trim(t) IN (cache_key, kind || '/' || roi, label))
    UNION ALL SELECT 'unmatched', trim(t) FROM {TERMS} WHERE NOT EXISTS (SELECT 1 FROM {SCORED} WHERE trim(t) IN (cache_key, kind || '/' || roi, label))""",
)
def candidate_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows, terms = _candidates(spark, sf), _terms(spark, sf)
    yes = W.chosen(rows, terms).select(F.lit("chosen").alias("part"), F.col("label").alias("item"))
    no = W.unmatched_terms(rows, terms).select(F.lit("unmatched").alias("part"), F.col("term").alias("item"))
    return yes.unionByName(no)


RANKED = f"""(SELECT *, row_number() OVER (ORDER BY val_mae, label) AS rank, lead(val_mae) OVER (ORDER BY val_mae, label) AS nxt FROM {SCORED})"""


@query(
    "candidate_ranking",
    "W13 S11",
    f"""SELECT label, kind, roi, balance, round(val_mae, 4) AS val_mae, round(val_r2, 4) AS val_r2, cast(rank AS INTEGER) AS rank, rank = 1 AS selected FROM {RANKED}""",
)
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return W.report(_candidates(spark, sf))


@query(
    "selection_gap",
    "W13 W14: by error",
    f"SELECT label, {r('abs(nxt - val_mae)', 'gap')}, abs(nxt - val_mae) < 0.1e0 AS near_tie FROM {RANKED} WHERE rank = 1",
)
def selection_gap(spark: SparkSession, sf: str) -> DataFrame:
    return published(W.winner(_candidates(spark, sf)).select("label", "gap", "near_tie"))


@query(
    "selection_by_r2",
    "W13 W14: higher is better, ties still by label, per head",
    f"""SELECT head, label, {r('abs(nxt - val_r2)', 'gap')} FROM (SELECT *, row_number() OVER w AS rank, lead(val_r2) OVER w AS nxt FROM
    (SELECT head, {LABEL} AS label, 1 - sum(pow(y_pred-y_true, 2))/regr_sxx(y_true, y_true) AS val_r2 FROM {CA} WHERE y_pred IS NOT NULL AND ({REASON}) IS NULL
     GROUP BY head, kind, roi, balance) WINDOW w AS (PARTITION BY head ORDER BY val_r2 DESC, label)) WHERE rank = 1""",
)
def selection_by_r2(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf, ("head", "kind", "roi", "balance"))
    return published(W.winner(rows, "r2", by=["head"]).select("head", "label", "gap"))


@query(
    "sweep_report_round_trip",
    "S10 S11 S13: written as JSON, read back, winner first",
    f"""SELECT label, round(val_mae, 4) AS val_mae, round(val_r2, 4) AS val_r2, rank = 1 AS selected,
    (SELECT abs(nxt - val_mae) < 0.1e0 FROM {RANKED} WHERE rank = 1) AS near_tie, 'mae' AS metric FROM {RANKED}""",
)
def sweep_report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf)
    header = W.winner(rows).select(F.lit("mae").alias("metric"), F.col("gap").alias("selection_gap"))
    report = reports.sweep_report(W.report(rows), header)
    path = shared_folder(spark)
    reports.write_report(report, path)
    back = reports.read_report(spark, path, report)
    summary = reports.sweep_summary(back)
    return summary.select("label", "val_mae", "val_r2", "selected", "near_tie", F.lit("mae").alias("metric"))


# --- head and holdout tables ------------------------------------------------------

HEADS = f"""SELECT h.*, site_mae_gap, site_bias_gap, worst_site, worst_site_n FROM (SELECT head, {AQ.REPORT_SQL} FROM {OK} GROUP BY head) h
 JOIN (SELECT head, {r('max(mae) - avg(mae)', 'site_mae_gap')}, {r('abs(arg_max(bias, abs(bias)) - avg(bias))', 'site_bias_gap')},
 arg_max(site, mae) AS worst_site, arg_max(n, mae) AS worst_site_n FROM (SELECT head, site, count(*) AS n, avg(abs(d)) AS mae, avg(d) AS bias
 FROM {OK} GROUP BY head, site) GROUP BY head) s USING (head)"""
HEAD_COLUMNS = "head, n, mae, rmse, r2, pearson_r, bias, loa_lower, loa_upper, within_1, within_2, site_mae_gap, site_bias_gap, worst_site, worst_site_n"


@query("head_table", "A45", f"SELECT {HEAD_COLUMNS} FROM ({HEADS})")
def head_table(spark: SparkSession, sf: str) -> DataFrame:
    return published(B.head_table(PRED.frame(spark, sf)))


@query("best_head", "O7", f"SELECT arg_max(head, r2) AS head, max(r2) AS r2 FROM ({HEADS})")
def best_head(spark: SparkSession, sf: str) -> DataFrame:
    return published(B.best_head(B.head_table(PRED.frame(spark, sf))))


PAIR = "CASE site WHEN 'AFRICA' THEN 'AMERICA' WHEN 'AMERICA' THEN 'ASIA' WHEN 'ASIA' THEN 'EUROPE' WHEN 'EUROPE' THEN 'MIDDLE EAST' ELSE 'AFRICA' END"
MEANS = f"(SELECT site, avg(y_true) AS mean FROM {OK} GROUP BY site)"


@query(
    "holdout_table",
    "A46 O5",
    f"""SELECT head, train_site || '->' || test_site AS fold, train_site, test_site, n, mae, r2, bias, sex_mae_gap,
    {r('mt.mean', 'mean_truth_test_site')}, {r('mr.mean', 'mean_truth_train_site')} FROM
    (SELECT head, {PAIR} AS train_site, site AS test_site, count(*) AS n, {r('avg(abs(d))', 'mae')}, {r('1 - sum(d*d)/regr_sxx(y_true, y_true)', 'r2')},
     {r('avg(d)', 'bias')} FROM {OK} GROUP BY head, site) h
    JOIN (SELECT head, site, {r('max(m) - avg(m)', 'sex_mae_gap')} FROM (SELECT head, site, sex, avg(abs(d)) AS m FROM {OK} GROUP BY head, site, sex)
     GROUP BY head, site) g USING (head) JOIN {MEANS} mt ON mt.site = test_site JOIN {MEANS} mr ON mr.site = train_site WHERE g.site = test_site""",
)
def holdout_table(spark: SparkSession, sf: str) -> DataFrame:
    df = finite_rows(PRED.frame(spark, sf), "y_true", "y_pred").withColumn("train_site", F.expr(PAIR))
    scored = df.withColumnRenamed("site", "test_site").withColumn("fold", F.concat_ws("->", "train_site", "test_site"))
    means = df.groupBy("site").agg(F.avg("y_true").alias("mean"))
    out = B.holdout_table(scored, means)
    return published(
        out.select(
            "head", "fold", "train_site", "test_site", "n", "mae", "r2", "bias", "sex_mae_gap",
            "mean_truth_test_site", "mean_truth_train_site",
        )
    )


SHIFT = "(y_pred + cast(length(t.site) - 5 as double) / 8)"
ALL_PAIRS = f"(SELECT o.head, t.site AS train_site, o.site AS test_site, o.sex, y_true, {SHIFT} - y_true AS d FROM {OK} o JOIN (SELECT DISTINCT site FROM {OK}) t ON t.site <> o.site)"


@query(
    "holdout_directions",
    "A46 O5: all ordered pairs of sites",
    f"""SELECT head, train_site || '->' || test_site AS fold, train_site, test_site, n, mae, r2, bias, sex_mae_gap,
    {r('mt.mean', 'mean_truth_test_site')}, {r('mr.mean', 'mean_truth_train_site')} FROM
    (SELECT head, train_site, test_site, count(*) AS n, {r('avg(abs(d))', 'mae')}, {r('1 - sum(d*d)/regr_sxx(y_true, y_true)', 'r2')},
     {r('avg(d)', 'bias')} FROM {ALL_PAIRS} GROUP BY ALL) h
    JOIN (SELECT head, train_site, test_site, {r('max(m) - avg(m)', 'sex_mae_gap')} FROM (SELECT head, train_site, test_site, sex, avg(abs(d)) AS m FROM {ALL_PAIRS} GROUP BY ALL)
     GROUP BY ALL) g USING (head, train_site, test_site) JOIN {MEANS} mt ON mt.site = test_site JOIN {MEANS} mr ON mr.site = train_site""",
)
def holdout_directions(spark: SparkSession, sf: str) -> DataFrame:
    df = written(finite_rows(PRED.frame(spark, sf), "y_true", "y_pred").select("head", "site", "sex", "y_true", "y_pred"))
    means = df.groupBy("site").agg(F.avg("y_true").alias("mean"))
    # A head per training site, as a model of another site would predict these rows.
    sites = sorted(row["site"] for row in means.select("site").collect())
    others = F.array_except(F.array(*[F.lit(s) for s in sites]), F.array("site"))
    scored = df.select("*", F.explode(others).alias("train_site")).withColumnRenamed("site", "test_site")
    scored = scored.withColumns({"y_pred": F.col("y_pred") + (F.length("train_site") - 5).cast("double") / 8, "fold": F.concat_ws("->", "train_site", "test_site")})
    return published(B.holdout_table(scored, means).select("head", "fold", "train_site", "test_site", "n", "mae", "r2", "bias", "sex_mae_gap", "mean_truth_test_site", "mean_truth_train_site"))


@query(
    "printed_head_table",
    "S14 S19 O5: text projection in display order",
    f"""SELECT head, cast(n AS VARCHAR) AS n, printf('%.2f', mae) AS mae, printf('%.2f', r2) AS r2, printf('%.2f', bias) AS bias,
    cast(CASE head WHEN 'ordinal' THEN 0 WHEN 'regression' THEN 1 ELSE 2 END AS VARCHAR) AS display FROM ({HEADS})""",
)
def printed_head_table(spark: SparkSession, sf: str) -> DataFrame:
    table = B.head_table(PRED.frame(spark, sf)).select("head", "n", "mae", "r2", "bias")
    ranked = table.withColumn("display", reports.head_rank(F.col("head"))).orderBy("display")
    return reports.text_table(ranked)


def _site_ece(group: str) -> str:
    return f"""SELECT head, {group} AS site, sum(n) AS n, sum(n*abs(acc-conf))/sum(n) AS ece FROM (SELECT head, {group}, {SQ.BIN} AS bin, count(*) AS n,
     avg(conf) AS conf, avg(hit) AS acc FROM (SELECT *, confidence AS conf FROM {SQ.SCORED}) GROUP BY ALL) GROUP BY ALL"""


@query(
    "results_report_round_trip",
    "S10 S12 S18: nested report written, read back and flattened",
    f"""WITH e AS ({_site_ece('site')}), p AS ({_site_ece("'pooled'")})
    SELECT e.head, e.site, cast(e.n AS BIGINT) AS n, {r('e.ece', 'ece')}, {r('p.ece', 'pooled_ece')},
    {r('(SELECT max(x.ece) - min(x.ece) FROM e x WHERE x.head = e.head)', 'max_ece_gap')}, '{CONFOUND_NOTE}' AS confound,
    (SELECT count(*) FROM {OK}) AS n_patients FROM e JOIN p USING (head)""",
)
def results_report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    df = finite_rows(PRED.frame(spark, sf), "y_true", "y_pred")
    df = df.withColumn("hit", F.abs(F.col("y_pred") - F.col("y_true")) <= 1.0)
    stats = df.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("mean"), F.lit(None).cast("double").alias("mean_age")
    )
    audit = C.site_calibration_by(df, "confidence", "hit", "site", ["head"])
    report = reports.results_report(B.head_table(df), stats, audit, {"corpus": "unknown"})
    path = shared_folder(spark)
    reports.write_report(report, path)
    back = reports.read_report(spark, path, report)
    flat = reports.report_site_ece(back).withColumn("n_patients", back.select("corpus.n_patients").scalar())
    return published(flat)


CONFIG_ROWS = " UNION ALL ".join(
    f"SELECT 'config', '', '{k}', cast({v} AS DOUBLE)"
    for k, v in reports.settings_of(AuditConfig()).items()
    if isinstance(v, (int, float)) and not isinstance(v, bool)
)
SITES_N = f"(SELECT site, count(*) AS n FROM {OK} GROUP BY site)"


@query(
    "results_report_sections",
    "S10 S12 S18: settings, cross-site sizes and coverage per head, with manifest, written and read back",
    f"""{SQ._curve_sql('head')}, t(target) AS (VALUES (1.0e0), (0.9e0), (0.8e0), (0.7e0)),
    x AS (SELECT *, row_number() OVER (PARTITION BY head, target ORDER BY abs(coverage-target), point) AS pick FROM c, t),
    y AS (SELECT head || '@' || printf('%.1f', target) AS grp, coverage, mae FROM x WHERE pick = 1),
    z AS (SELECT a.site || '->' || b.site AS grp, a.n AS n_train, b.n AS n_test FROM {SITES_N} a JOIN {SITES_N} b ON a.site <> b.site)
    SELECT section, grp, metric, {r('value', 'value')}, 64 AS fingerprint_length, 'unknown' AS corpus_kind, (SELECT count(*) FROM {OK}) AS n_patients FROM (
    SELECT 'coverage' AS section, grp, 'coverage' AS metric, cast(coverage AS DOUBLE) AS value FROM y UNION ALL SELECT 'coverage', grp, 'mae', mae FROM y
    UNION ALL SELECT 'site_holdout', grp, 'n_train', n_train FROM z UNION ALL SELECT 'site_holdout', grp, 'n_test', n_test FROM z
    UNION ALL {CONFIG_ROWS})""",
)
def results_report_sections(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.operators import coverage as V
    from assaymill.operators.splits import holdout_sizes

    df = finite_rows(PRED.frame(spark, sf), "y_true", "y_pred")
    df = df.withColumn("hit", F.abs(F.col("y_pred") - F.col("y_true")) <= 1.0)
    stats = df.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("mean"), F.lit(None).cast("double").alias("mean_age")
    )
    audit = C.site_calibration_by(df, "confidence", "hit", "site", ["head"])
    sites = sorted(row["site"] for row in stats.select("site").collect())
    curve = V.risk_coverage(df.withColumn("unc", 1 - F.col("confidence")), "unc", "id", by=["head"])
    coverage = V.at_coverages(curve, (1.0, 0.9, 0.8, 0.7), ["head"]).select("head", "target", "coverage", "mae")
    report = reports.results_report(
        B.head_table(df), stats, audit, {"corpus": "unknown"}, AuditConfig(), holdout_sizes(df, "site", sites), coverage
    )
    path = shared_folder(spark)
    reports.write_report(report, path)
    back = reports.read_report(spark, path, report)
    facts = {
        "fingerprint_length": back.select(F.length("fingerprint")).scalar(),
        "corpus_kind": back.select("corpus_kind").scalar(),
        "n_patients": back.select("corpus.n_patients").scalar(),
    }
    return published(reports.report_sections(back).withColumns(facts))


# --- stored tables ----------------------------------------------------------------

STORED = [f"f{i}" for i in range(1, 5)]


@query(
    "feature_store_round_trip",
    "S6 S7",
    f"SELECT id AS patient_id, {', '.join(f'round({c}, 6) + 0.0e0 AS {c}' for c in STORED)} FROM ({FEATURES.sql()})",
)
def feature_store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    df = FEATURES.frame(spark, sf).select(F.col("id").alias("patient_id"), *STORED)
    path, mark = shared_folder(spark), feature_store.config_fingerprint({"columns": STORED})
    feature_store.save(df, path, "colour", "palpebral", "raw", mark)
    feature_store.save(df.withColumn("f1", -F.col("f1")), path, "colour", "palpebral", "balanced", mark)
    return published(feature_store.load(spark, path, "colour", "palpebral", "raw", mark, df))


@query(
    "prediction_file_round_trip",
    "S1 F2 S9 S19: CSV with other column names, read by suffix",
    f"SELECT head, site, {AQ.REPORT_SQL} FROM {OK} GROUP BY head, site",
)
def prediction_file_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf).select("head", "site", F.col("y_true").alias("Hb"), F.col("y_pred").alias("Hb_hat"))
    path = f"{shared_folder(spark)}/predictions.csv"
    df.write.option("header", True).csv(path)
    return published(A.agreement(predictions.read_predictions(spark, path), by=["head", "site"]))


@query(
    "prediction_json_lines",
    "S1 F2: JSON lines with other column names, read by suffix",
    f"SELECT head, site, {AQ.REPORT_SQL} FROM {OK} GROUP BY head, site",
)
def prediction_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf).select("head", "site", F.col("y_true").alias("Hb"), F.col("y_pred").alias("Hb_hat"))
    path = f"{shared_folder(spark)}/predictions.jsonl"
    df.write.json(path)
    return published(A.agreement(predictions.read_predictions(spark, path), by=["head", "site"]))


def _counts(done: sinks.Stored) -> dict[str, Column]:
    return {name: F.lit(getattr(done, name)).cast("long") for name in ("rows_in", "rows_written", "rows_dropped")}


@query(
    "stored_predictions",
    "S9 S18 S19: per-patient predictions stored by head and fold, counted by the write itself",
    f"""WITH j AS (SELECT a.y_true, b.y_pred, c.head FROM {P} a JOIN {P} b ON a.id = b.id JOIN {P} c ON c.id = a.id),
    k AS (SELECT head, round(y_pred, 4) AS p, round(y_pred - y_true, 4) AS e FROM j WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)
    SELECT head, count(*) AS n, {r('round(avg(abs(e)), 4)', 'mae', 4)}, {r('min(p)', 'lowest')}, {r('max(p)', 'highest')},
    (SELECT count(*) FROM j) AS rows_in, (SELECT count(*) FROM k) AS rows_written, (SELECT count(*) FROM j) - (SELECT count(*) FROM k) AS rows_dropped
    FROM k GROUP BY head""",
)
def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf)
    people = df.select(F.col("id").alias("patient_id"), "site", "sex", F.lit(None).cast("double").alias("age"), "y_true")
    guesses = df.select(F.col("id").alias("patient_id"), "head", "y_pred", F.concat_ws("->", "site", "sex").alias("fold"))
    rows = predictions.with_attributes(guesses, people).join(guesses.select("patient_id", "head", "fold"), "patient_id")
    path = f"{shared_folder(spark)}/predictions"
    predictions.write_predictions(rows, path, settings={"query": "stored_predictions"})
    done = sinks.manifest_of(spark, path)
    return published(predictions.stored_by_head(spark.read.parquet(path)).withColumns(_counts(done)))


@query(
    "stored_union",
    "S8 X4: rows of two shapes stored under the union of their columns",
    f"""SELECT site, count(*) AS n, count(y_pred) AS n_pred, count(sigma) AS n_sigma, (SELECT 2 * count(*) FROM {P}) AS rows_in,
    (SELECT 2 * count(*) FROM {P}) AS rows_written, 0 AS rows_dropped
    FROM (SELECT site, y_pred, CAST(NULL AS DOUBLE) AS sigma FROM {P} UNION ALL SELECT site, NULL, sigma FROM {P}) GROUP BY site""",
)
def stored_union(spark: SparkSession, sf: str) -> DataFrame:
    df = PRED.frame(spark, sf)
    path = f"{shared_folder(spark)}/union"
    done = sinks.store(union_of_keys(df.select("id", "site", "y_pred"), df.select("id", "site", "sigma")), path)
    counts = spark.read.parquet(path).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count("y_pred").alias("n_pred"), F.count("sigma").alias("n_sigma"))
    return counts.withColumns(_counts(done))


@query("feature_fingerprints", "Q22: equal feature tables share a fingerprint")
def feature_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    df = FEATURES.frame(spark, sf)
    tables = {"a": STORED, "again": STORED, "b": ["f6", "f7", "f8", "f9"]}
    prints = [T.fingerprint(df, "id", c).withColumn("label", F.lit(k)) for k, c in tables.items()]
    return W.same_features(prints[0].unionByName(prints[1]).unionByName(prints[2]))


# --- the whole audit ---------------------------------------------------------------


def _metric(section: str, group: str, source: str, **metrics: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {group} AS grp, '{m}' AS metric, {r(f'cast({e} AS DOUBLE)', 'value')} FROM ({source})"
        for m, e in metrics.items()
    )


AUDIT = " UNION ALL ".join(
    [
        _metric(
            "regression", "site",
            f"SELECT CASE WHEN grouping(site) = 1 THEN 'pooled' ELSE site END AS site, {AQ.REPORT_SQL} FROM {OK} GROUP BY GROUPING SETS ((site), ())",
            n="n", mae="mae", rmse="rmse", r2="r2", bias="bias", loa_lower="loa_lower", loa_upper="loa_upper",
        ),
        _metric(
            "rank_correlation", "'pooled'",
            f"""SELECT covar_pop(a,b)/(stddev_pop(a)*stddev_pop(b)) AS v FROM (SELECT rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1)/2.0e0 AS a,
            rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1)/2.0e0 AS b FROM {OK})""",
            spearman_rho="v",
        ),
        _metric(
            "screening", "site || '/' || band",
            f"SELECT site, band, {SQ.RATES} FROM ({SQ._banded(OK, SQ.POOLED_SITE, 'GROUPING SETS ((site), ())')})",
            tp="tp", fn="fn", fp="fp", tn="tn", sensitivity="sensitivity", specificity="specificity",
        ),
        _metric("calibration", "site", SQ.ECE_SITE, ece="ece"),
        _metric(
            "fairness", "'pooled'",
            f"SELECT slope, sqrt((syy - slope*sxy)/(n-2)/sxx) AS se, 1 - (syy - slope*sxy)/syy AS r2 FROM (SELECT count(*) AS n, regr_slope(d, ita) AS slope,"
            f" regr_sxx(d, ita) AS sxx, regr_syy(d, ita) AS syy, regr_sxy(d, ita) AS sxy FROM {OK})",
            slope="slope", se="se", r2="r2",
        ),
        _metric(
            "coverage", "cast(target AS VARCHAR)",
            f"""SELECT * FROM ({SQ._curve_sql('')}, t(target) AS (VALUES (1.0e0), (0.9e0), (0.8e0), (0.7e0)),
            x AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(coverage-target), point) AS pick FROM c, t) SELECT * FROM x WHERE pick = 1)""",
            coverage="coverage", mae="mae",
        ),
    ]
)


@query("full_audit", "L9: every section of the audit, in long form", AUDIT)
def full_audit(spark: SparkSession, sf: str) -> DataFrame:
    return published(long_form(evaluate(PRED.frame(spark, sf), cfg=AuditConfig())))
