"""Event validation, caps, limits and their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import AuditConfig
from assaymill.operators import events as E
from assaymill.plans.registry import published, query, r
from assaymill.plans.views import BODIES, FEEDBACK, TELEMETRY
from assaymill.session import configure, shared_folder
from assaymill.sources.events import stream_events
from assaymill.streaming import intake as S

TL = f"({TELEMETRY.sql()})"
BD = f"({BODIES.sql()})"
BANDS = ", ".join(f"'{b}'" for b in E.BANDS)
DAY_MS = 86_400_000


def _telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return TELEMETRY.frame(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    return BODIES.frame(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = stream_events(configure(spark), sf, name="events.parquet")
    return TELEMETRY.over(raw).withColumn("ts", F.col("ts").cast("timestamp"))


NAMED = "regexp_full_match(model_id, '[a-z0-9._-]+') AND length(model_id) <= 64"
STRICT = f"""CASE WHEN NOT ({NAMED}) THEN 'model_id' WHEN band NOT IN ({BANDS}) THEN 'band' WHEN hb_hat NOT BETWEEN 3 AND 25 THEN 'hb_hat'
 WHEN sigma NOT BETWEEN 0 AND 10 THEN 'sigma' WHEN quality NOT BETWEEN 0 AND 1 THEN 'quality'
 WHEN latency_ms NOT BETWEEN 0 AND 60000 THEN 'latency_ms' WHEN latency_ms <> floor(latency_ms) THEN 'latency_ms' END"""


@query("telemetry_validation", "F17 S16", f"SELECT event_id, {STRICT} AS error_field FROM {TL}")
def telemetry_validation(spark: SparkSession, sf: str) -> DataFrame:
    return _telemetry(spark, sf).select("event_id", E.field_error().alias("error_field"))


@query(
    "telemetry_sanitising",
    "F18",
    f"""SELECT event_id, model_id, band, CASE WHEN hb_hat BETWEEN 3 AND 25 THEN hb_hat END AS hb_hat,
    CASE WHEN sigma BETWEEN 0 AND 10 THEN sigma END AS sigma, CASE WHEN quality BETWEEN 0 AND 1 THEN quality END AS quality,
    CASE WHEN latency_ms BETWEEN 0 AND 60000 THEN cast(floor(latency_ms) AS INTEGER) END AS latency_ms FROM {TL}
    WHERE regexp_full_match(model_id, '[a-z0-9._-]+') AND band IN ({BANDS})""",
)
def telemetry_sanitising(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("event_id", "model_id", "band", *E.RANGES)
    return E.lenient_payload(_telemetry(spark, sf)).select(*fields)


BODY = """CASE WHEN strlen(body) > 1024 THEN 'PAYLOAD_TOO_LARGE' WHEN NOT json_valid(body) THEN 'INVALID_BODY'
 WHEN json_type(body) <> 'OBJECT' THEN 'INVALID_BODY' END"""


@query("body_rules", "F19 M22", f"SELECT event_id, {BODY} AS code FROM {BD}")
def body_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _bodies(spark, sf).select("event_id", E.body_error(F.col("body")).alias("code"))


def _json(name: str, low: int, high: int) -> str:
    kind = f"json_type(body, '$.{name}')"
    value = f"try_cast(json_extract_string(body, '$.{name}') AS DOUBLE)"
    return f"""WHEN {kind} IS NOT NULL AND ({kind} NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR {value} NOT BETWEEN {low} AND {high}) THEN '{name}'"""


MODEL = "json_extract_string(body, '$.model_id')"
BAND = "json_extract_string(body, '$.band')"
FIELD = f"""CASE WHEN coalesce(json_type(body, '$.model_id') <> 'VARCHAR' OR NOT (regexp_full_match({MODEL}, '[a-z0-9._-]+') AND length({MODEL}) <= 64), true) THEN 'model_id'
 WHEN coalesce(json_type(body, '$.band') <> 'VARCHAR' OR {BAND} NOT IN ({BANDS}), true) THEN 'band'
 {_json('hb_hat', 3, 25)} {_json('sigma', 0, 10)} {_json('quality', 0, 1)} {_json('latency_ms', 0, 60000)}
 WHEN try_cast(json_extract_string(body, '$.latency_ms') AS DOUBLE) <> floor(try_cast(json_extract_string(body, '$.latency_ms') AS DOUBLE)) THEN 'latency_ms' END"""
JUDGED = f"""(SELECT event_id, key, ts, body, code0, CASE WHEN code0 IS NULL THEN {FIELD.replace('body', 'safe')} END AS error_field FROM
 (SELECT *, {BODY} AS code0, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS safe FROM {BD}))"""
ROUTED = f"""SELECT event_id, error_field, coalesce(code0, CASE WHEN error_field IS NOT NULL THEN 'INVALID_BODY' END) AS code FROM {JUDGED}"""


@query("body_fields", "F17 F19: fields typed by their JSON type", ROUTED)
def body_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = E.judged_bodies(_bodies(spark, sf))
    code = F.coalesce("body_code", F.when(F.col("error_field").isNotNull(), E.INVALID))
    return df.select("event_id", "error_field", code.alias("code"))


@query(
    "feedback_validation",
    "F20 S17",
    f"SELECT event_id, CASE WHEN lab NOT BETWEEN 3 AND 25 THEN 'hb' END AS error_field FROM {TL}",
)
def feedback_validation(spark: SparkSession, sf: str) -> DataFrame:
    return _telemetry(spark, sf).select("event_id", E.feedback_error(F.col("lab")).alias("error_field"))


@query(
    "events_per_day",
    "A44 M21",
    f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM {TL} GROUP BY 1",
)
def events_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return E.rows_per_day(_telemetry(spark, sf))


CAP = f"""SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) <= 300 AS accepted FROM {TL}"""


@query("daily_cap", "W16", CAP)
def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    return E.daily_cap(_telemetry(spark, sf), 300).select("event_id", "accepted")


def limit_sql(limit: int, window_ms: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, key, epoch_ms(ts) AS ms FROM {TL}),
     a(key, anchor) AS (SELECT key, min(ms) FROM e GROUP BY key
       UNION ALL SELECT a.key, (SELECT min(ms) FROM e WHERE e.key = a.key AND e.ms > a.anchor + {window_ms}) FROM a
       WHERE (SELECT max(ms) FROM e WHERE e.key = a.key) > a.anchor + {window_ms}),
     j AS (SELECT event_id, e.key, ms, max(anchor) AS anchor FROM e JOIN a ON a.key = e.key AND a.anchor <= e.ms GROUP BY event_id, e.key, ms)
     SELECT event_id, row_number() OVER (PARTITION BY key, anchor ORDER BY ms, event_id) <= {limit} AS allowed FROM j"""


@query("rate_limit_daily", "W15: five per key and anchored day", limit_sql(5, DAY_MS))
def rate_limit_daily(spark: SparkSession, sf: str) -> DataFrame:
    return E.rate_limit(_telemetry(spark, sf), limit=5, window_ms=DAY_MS).select("event_id", "allowed")


@query("rate_limit_hourly", "W15: one per key and anchored six hours, many chunks", limit_sql(1, DAY_MS // 4))
def rate_limit_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return E.rate_limit(_telemetry(spark, sf), limit=1, window_ms=DAY_MS // 4).select("event_id", "allowed")


def intake_sql(judged: str, cap: int) -> str:
    return f"""WITH l AS ({limit_sql(5, DAY_MS)}), j AS (SELECT x.*, allowed, CASE WHEN NOT allowed THEN 'RATE_LIMITED' WHEN code0 IS NOT NULL THEN code0
     WHEN error_field IS NOT NULL THEN 'INVALID_BODY' END AS code FROM {judged} x JOIN l USING (event_id)),
    c AS (SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) > {cap} THEN 'RATE_LIMITED' END AS code,
     cast(NULL AS VARCHAR) AS error_field FROM j WHERE code IS NULL)
    SELECT event_id, code, error_field FROM c UNION ALL
    SELECT event_id, code, CASE WHEN allowed THEN error_field END FROM j WHERE code IS NOT NULL"""


# Limits at which the given events, a few per user and day, are refused at all.
TELEMETRY_CFG = AuditConfig(rate_limit=5, rate_window_ms=DAY_MS, telemetry_daily_cap=120)
FEEDBACK_CFG = AuditConfig(rate_limit=5, rate_window_ms=DAY_MS, feedback_daily_cap=100)
HB = "try_cast(json_extract_string(safe, '$.hb') AS DOUBLE)"
REPORTED = f"""(SELECT event_id, key, ts, code0, CASE WHEN code0 IS NULL AND NOT coalesce(json_type(safe, '$.hb') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND {HB} BETWEEN 3 AND 25, false)
 THEN 'hb' END AS error_field FROM (SELECT *, {BODY} AS code0, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS safe FROM ({FEEDBACK.sql()})))"""


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return FEEDBACK.frame(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _answers(df: DataFrame) -> DataFrame:
    return df.select("event_id", "code", "error_field")


@query("event_intake", "F17 F19 W15 W16 in order", intake_sql(JUDGED, 120))
def event_intake(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(E.intake(_bodies(spark, sf), TELEMETRY_CFG))


@query("feedback_intake", "F19 F20 S17 W15 W16: laboratory values, with limit and cap of their own", intake_sql(REPORTED, 100))
def feedback_intake(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(E.intake(_reports(spark, sf), FEEDBACK_CFG, "feedback"))


@query("event_intake_stream", "T1 T2 T3 F17 F19 W15 W16: the whole chain on a stream", intake_sql(JUDGED, 120))
def event_intake_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    S.intake(BODIES.over(_stream(spark, sf)), folder, "telemetry", TELEMETRY_CFG)
    return _answers(S.taken_in(spark, folder))


@query("feedback_stream", "T1 T2 T3 F20 S17: laboratory values on a stream", intake_sql(REPORTED, 100))
def feedback_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    S.intake(FEEDBACK.over(_stream(spark, sf)), folder, "feedback", FEEDBACK_CFG)
    return _answers(S.taken_in(spark, folder))


DAYS = f"SELECT strftime(ts, '%Y-%m-%d') AS day, band, count(*) AS n FROM {TL} GROUP BY 1, 2"


@query("day_band_counts", "T5: batch twin", DAYS)
def day_band_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.counts_by_day_and_band(_telemetry(spark, sf))


@query("day_band_counts_stream", "T5", DAYS)
def day_band_counts_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    S.counted(_stream(spark, sf), folder)
    return S.newest(spark, folder)


@query("routed_stream", "T1 S16", ROUTED)
def routed_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    S.route(BODIES.over(_stream(spark, sf)), folder)
    return S.routed(spark, folder).select("event_id", "error_field", "code")


@query("daily_cap_stream", "T2", CAP)
def daily_cap_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    S.capped(_stream(spark, sf).select("event_id", "ts"), folder, 300)
    return spark.read.parquet(f"{folder}/rows").select("event_id", "accepted")


@query("rate_limit_stream", "T3", limit_sql(5, DAY_MS))
def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    S.store(S.limited(_stream(spark, sf), 5, DAY_MS), folder)
    return spark.read.parquet(folder).select("event_id", "allowed")


@query(
    "screening_log",
    "S15 M21: field-screening export",
    f"""SELECT cast(event_id AS VARCHAR) AS patient_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS "timestamp",
    coalesce(printf('%.2f', hb_hat), 'N/A') AS hb_gdl, CASE WHEN hb_hat IS NULL THEN 'abstain' WHEN hb_hat >= 12 THEN 'within_range'
    WHEN hb_hat >= 9 THEN 'mild' WHEN hb_hat >= 7 THEN 'moderate' ELSE 'severe' END AS who_band,
    coalesce(printf('%.2f', hb_hat - 1.5e0*sigma), '') AS lo, coalesce(printf('%.2f', hb_hat + 1.5e0*sigma), '') AS hi,
    CASE WHEN hb_hat IS NULL THEN 'abstained' ELSE 'ok' END AS status FROM {TL}""",
)
def screening_log(spark: SparkSession, sf: str) -> DataFrame:
    from assaymill.sources.reports import screening_log as export

    df = _telemetry(spark, sf).select(F.col("event_id").cast("string").alias("patient_id"), "ts", "hb_hat", "sigma")
    spread = 1.5 * F.col("sigma")
    df = df.withColumns(
        {
            "lo": F.col("hb_hat") - spread,
            "hi": F.col("hb_hat") + spread,
            "status": F.when(F.col("hb_hat").isNull(), "abstained").otherwise("ok"),
        }
    )
    return export(df)


@query(
    "sigma_by_band",
    "S16: typed event table",
    f"SELECT band, count(*) AS n, {r('avg(sigma)', 'sigma')}, {r('avg(quality)', 'quality')} FROM {TL} GROUP BY band",
)
def sigma_by_band(spark: SparkSession, sf: str) -> DataFrame:
    return published(
        _telemetry(spark, sf).groupBy("band").agg(
            F.count(F.lit(1)).alias("n"), F.avg("sigma").alias("sigma"), F.avg("quality").alias("quality")
        )
    )
