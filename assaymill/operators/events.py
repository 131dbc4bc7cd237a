"""Rules of event intake: body, fields, caps and rate limits, in batch form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.session import written

# fixed values: accepted names and ranges of the intake contract
BANDS = ("severe", "moderate", "mild", "within_range", "abstained")
MODEL_ID = "^[a-z0-9._-]+$"
MODEL_ID_LENGTH = 64
RANGES = {"hb_hat": (3.0, 25.0), "sigma": (0.0, 10.0), "quality": (0.0, 1.0), "latency_ms": (0.0, 60000.0)}
TOO_LARGE, INVALID, LIMITED = "PAYLOAD_TOO_LARGE", "INVALID_BODY", "RATE_LIMITED"
NUMBER_TYPE = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
# ------------------------------------------------------------------------------


def _rules(body: Column, parsed: Column, cfg: AuditConfig) -> Column:
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return (
        F.when(body.isNull(), INVALID)
        .when(F.octet_length(body) > cfg.max_body_bytes, TOO_LARGE)
        .when(~is_object, INVALID)
    )


def body_error(body: Column, cfg: AuditConfig = DEFAULTS) -> Column:
    """Size, syntax, shape: the first rule a body breaks, else NULL."""
    return _rules(body, F.try_parse_json(body), cfg)


def _field(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "variant")


def _typed(df: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Columns from the variant ``_v``; for a number also whether the key was there."""
    for name in texts:
        kind = F.schema_of_variant(_field(F.col("_v"), name))
        df = df.withColumn(name, F.when(kind == "STRING", F.try_variant_get(F.col("_v"), f"$.{name}", "string")))
    for name in numbers:
        part = _field(F.col("_v"), name)
        number = F.rlike(F.schema_of_variant(part), F.lit(NUMBER_TYPE))
        df = df.withColumns({name: F.when(number, F.try_variant_get(F.col("_v"), f"$.{name}", "double")), f"{name}_given": part.isNotNull()})
    return df


def parsed_fields(df: DataFrame, body: str = "body") -> DataFrame:
    """Typed fields of the body, with the JSON type of each; unknown keys vanish."""
    return _typed(df.withColumn("_v", F.try_parse_json(body)), ("model_id", "band"), tuple(RANGES)).drop("_v")


def judged_bodies(df: DataFrame, kind: str = "telemetry", cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """``df`` with the typed fields of its bodies, ``body_code`` and ``error_field``.

    A body is parsed once, and not at all beyond the size limit. ``body_code`` is the
    first rule of size, syntax and shape that it breaks; a row without a time has an
    invalid body. ``error_field`` names the first field that breaks the contract of
    ``kind``, of a body that keeps those rules.
    """
    small = F.when(F.octet_length("body") <= cfg.max_body_bytes, F.col("body"))
    parsed = df.withColumn("_v", F.try_parse_json(small))
    undated = F.col("ts").isNull() if "ts" in df.columns else F.lit(False)
    parsed = parsed.withColumn("body_code", F.when(undated, INVALID).otherwise(_rules(F.col("body"), F.col("_v"), cfg)))
    if kind == "feedback":
        fields = _typed(parsed, (), ("hb",))
        wrong = feedback_error(F.col("hb"), cfg)
    elif kind == "telemetry":
        fields = _typed(parsed, ("model_id", "band"), tuple(RANGES))
        wrong = field_error({n: F.col(f"{n}_given") for n in RANGES})
    else:
        raise ValueError(f"unknown kind of event {kind!r}")
    given = [c for c in fields.columns if c.endswith("_given")]
    return fields.withColumn("error_field", F.when(F.col("body_code").isNull(), wrong)).drop("_v", *given)


def _named(model_id: Column) -> Column:
    return F.coalesce(F.rlike(model_id, F.lit(MODEL_ID)) & (F.length(model_id) <= MODEL_ID_LENGTH), F.lit(False))


def field_error(given: dict[str, Column] | None = None) -> Column:
    """Name of the first field that breaks the strict contract, else NULL.

    ``given`` says whether an optional field was present; by default a value
    that is not NULL was.
    """
    chain = F.when(~_named(F.col("model_id")), "model_id").when(
        ~F.coalesce(F.col("band").isin(*BANDS), F.lit(False)), "band"
    )
    for name, (low, high) in RANGES.items():
        v = F.col(name)
        there = v.isNotNull() if given is None else given[name]
        chain = chain.when(there & ~F.coalesce(v.between(low, high), F.lit(False)), name)
        if name == "latency_ms":
            chain = chain.when(there & (v != F.floor(v)), name)
    return chain


def lenient_payload(df: DataFrame) -> DataFrame:
    """What a client sends: bad optionals are dropped, bad events are not sent."""
    out = df.where(F.rlike("model_id", F.lit(MODEL_ID)) & F.col("band").isin(*BANDS))
    clean = {n: F.when(F.col(n).between(low, high), F.col(n)) for n, (low, high) in RANGES.items()}
    clean["latency_ms"] = F.when(clean["latency_ms"] >= 0, F.floor(clean["latency_ms"])).cast("int")
    return out.withColumns(clean)


def feedback_error(value: Column, cfg: AuditConfig = DEFAULTS) -> Column:
    ok = F.coalesce(~F.isnan(value) & value.between(cfg.label_min, cfg.label_max), F.lit(False))
    return F.when(~ok, "hb")


def utc_day(ts: Column) -> Column:
    return F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd")


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rows_per_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    days = df.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return days.select(utc_day(F.col("w.start")).alias("day"), "n")


def daily_cap(df: DataFrame, cap: int, ts: str = "ts", row_id: str = "event_id", used: DataFrame | None = None) -> DataFrame:
    """Mark the first ``cap`` rows of every UTC day, by time and id.

    Counts per minute tell which minute a day's cap falls into, and counts per
    millisecond of that one minute where in it; only the rows of that millisecond are
    sorted, so a burst that fills a minute is no longer one task's work. ``used`` may
    bring the rows a day already has. A row without a time belongs to no day and is not
    accepted.
    """
    rows = df.withColumns({"_day": utc_day(F.col(ts)), "_minute": F.date_trunc("minute", ts)})
    cells = rows.groupBy("_day", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_before", _ahead("_minute", "_day"))
    if used is not None:
        base = used.select(F.col("day").alias("_day"), F.col("n").alias("_used"))
        cells = cells.join(base, "_day", "left").withColumn("_before", F.col("_before") + F.coalesce("_used", F.lit(0))).drop("_used")
    whole = F.col("_before") + F.col("_n") <= cap
    none = F.col("_before") >= cap
    placed = rows.join(written(cells), ["_day", "_minute"])
    decided = placed.where(whole | none).withColumn("accepted", whole)
    # The minute that the cap cuts, by milliseconds.
    cut = placed.where(~(whole | none)).withColumn("_ms", F.unix_millis(ts)).withColumnRenamed("_before", "_start").drop("_n")
    fine = cut.groupBy("_day", "_minute", "_start", "_ms").agg(F.count(F.lit(1)).alias("_n"))
    fine = fine.withColumn("_before", F.col("_start") + _ahead("_ms", "_day", "_minute")).drop("_start")
    inside = cut.drop("_start").join(written(fine), ["_day", "_minute", "_ms"])
    split = Window.partitionBy("_day", "_minute", "_ms").orderBy(ts, row_id)
    known = inside.where(whole | none).withColumn("accepted", whole)
    partly = inside.where(~(whole | none)).withColumn("accepted", F.col("_before") + F.row_number().over(split) <= cap)
    undated = rows.where(F.col(ts).isNull()).withColumn("accepted", F.lit(False))
    parts = [p.select(*df.columns, "accepted") for p in (decided, known, partly, undated)]
    return reduce(DataFrame.unionByName, parts)


def _ahead(cell: str, *group: str) -> Column:
    """Rows ``_n`` of the cells before this one."""
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(before), F.lit(0))


# --- rate limit with windows anchored at the first event ------------------------
#
# A window opens at a key's first event and takes every event up to window_ms
# later; the next event after that opens the next window. Windows of one key
# depend on each other, and one key may hold a third of all rows, so time is cut
# into chunks. Each chunk says, for every state it could be entered with, the
# state it is left with: a step function. Functions of neighbours compose to one
# of the same kind and size, FAN chunks at a time, level over level; then the
# levels hand the states down again, and all chunks are solved side by side. No
# task holds more than FAN functions of a key at once. Events are counted per
# millisecond first, so no chunk grows with the number of rows.
#
# Many small chunks share one Python call. Inside it the chunks lie one after
# another on a common time axis, far enough apart not to touch.

CHUNK_WINDOWS = 16
MAX_CHUNK_MS = 86_400_000
FAN = 256
START = -(2**62)
ROWS_PER_CALL = 100_000


def _calls(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Spread whole groups over enough calls for about ROWS_PER_CALL rows each."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    calls = max(least, -(-rows // ROWS_PER_CALL))
    return df.withColumn("call", F.pmod(F.xxhash64(*keys), F.lit(calls)))


def _axis(pdf: pd.DataFrame, window: int, chunk_ms: int, origin: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order, each one's chunk number, first rows, and shared-axis times."""
    pdf = pdf.sort_values(["key", "chunk", "ms"], ignore_index=True)
    new = (pdf["key"] != pdf["key"].shift()) | (pdf["chunk"] != pdf["chunk"].shift())
    part = np.cumsum(new.to_numpy()) - 1
    local = pdf["ms"].to_numpy(dtype=np.int64) - (pdf["chunk"].to_numpy(dtype=np.int64) + origin) * chunk_ms
    return pdf, part, np.flatnonzero(new.to_numpy()), part * (chunk_ms + 2 * window) + local


def _chunk_summary(window: int, chunk_ms: int, origin: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, part, first, t = _axis(pdf, window, chunk_ms, origin)
        n = len(t)
        after = np.searchsorted(t, t + window, side="right")
        inside = (after < n) & (part[np.minimum(after, n - 1)] == part)
        reach = np.where(inside, after, np.arange(n))
        while True:
            further = reach[reach]
            if np.array_equal(further, reach):
                break
            reach = further
        ms = pdf["ms"].to_numpy(dtype=np.int64)
        leave = ms[reach] + window
        # A chunk can be entered by its events up to one window in, and the next one.
        base = t[first] - (ms[first] - (pdf["chunk"].to_numpy(dtype=np.int64)[first] + origin) * chunk_ms)
        early = np.searchsorted(t, base + window, side="right")[part]
        entry = np.arange(n) <= early
        # Consecutive entries with the same exit: the last one answers for all.
        same = np.append((leave[1:] == leave[:-1]) & (part[1:] == part[:-1]) & entry[1:], False)
        keep = entry & ~same
        out = pd.DataFrame({"part": part[keep], "entry": ms[keep], "leave": leave[keep]})
        lists = out.groupby("part", sort=True).agg(list)
        lists.insert(0, "key", pdf["key"].to_numpy()[first])
        lists.insert(1, "chunk", pdf["chunk"].to_numpy()[first])
        return lists.reset_index(drop=True)

    return run


def _through(entry: np.ndarray, leave: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Where a chunk takes ``states``: its next event opens a window, or nothing happens."""
    at = np.searchsorted(entry, states, side="right")
    return np.where(at < len(entry), np.append(leave, 0)[at], states)


def _composed(pdf: pd.DataFrame, fan: int) -> pd.DataFrame:
    """Functions of the chunks of each block of ``fan``, as one function per block."""
    pdf = pdf.sort_values(["key", "chunk"], ignore_index=True)
    out: list[list] = []
    owner, beyond = None, 1
    for key, chunk, entry, leave in zip(pdf["key"], pdf["chunk"], pdf["entry"], pdf["leave"]):
        entry, leave = np.asarray(entry, np.int64), np.asarray(leave, np.int64)
        if (key, chunk // fan) != owner:
            owner, beyond = (key, chunk // fan), 1
            out.append([*owner, entry, leave])
            continue
        # A block is entered with a state of less than one window into its first chunk. So
        # one event of the chunks that follow, the first, is all such a state can meet.
        _, _, entries, leaves = out[-1]
        out[-1][2] = np.append(entries, entry[:beyond])
        out[-1][3] = np.append(_through(entry, leave, leaves), leave[:beyond])
        beyond = 0
        keep = np.append(out[-1][3][1:] != out[-1][3][:-1], True)
        out[-1][2], out[-1][3] = out[-1][2][keep], out[-1][3][keep]
    return pd.DataFrame(out, columns=["key", "chunk", "entry", "leave"])


def _handed(pdf: pd.DataFrame, fan: int) -> pd.DataFrame:
    """The state each chunk is entered with, from the one its block is entered with."""
    pdf = pdf.sort_values(["key", "chunk"], ignore_index=True)
    state, owner, states = START, None, []
    for key, chunk, entry, leave, into in zip(pdf["key"], pdf["chunk"], pdf["entry"], pdf["leave"], pdf["state"]):
        if (key, chunk // fan) != owner:
            state, owner = into, (key, chunk // fan)
        states.append(state)
        state = int(_through(np.asarray(entry, np.int64), np.asarray(leave, np.int64), np.array([state]))[0])
    return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "state": states})


def _entry_states(summary: DataFrame, span: int, moments: int, fan: int) -> DataFrame:
    """(key, chunk, state) by prefix composition over ``span`` chunk numbers."""
    function, levels = "key string, chunk long, entry array<long>, leave array<long>", [written(summary)]
    while span > fan:
        blocks = levels[-1].withColumn("block", F.floor(F.col("chunk") / fan))
        composed = _calls(blocks, ["key", "block"], moments).groupBy("call").applyInPandas(lambda pdf: _composed(pdf, fan), function)
        levels.append(written(composed))
        span, moments = -(-span // fan), -(-moments // fan)
    states = None
    for level in reversed(levels):
        blocks = level.withColumn("block", F.floor(F.col("chunk") / fan))
        if states is None:
            entered = blocks.withColumn("state", F.lit(START).cast("long"))
        else:
            entered = blocks.join(states.withColumnRenamed("chunk", "block"), ["key", "block"])
        states = _calls(entered, ["key", "block"], moments).groupBy("call").applyInPandas(lambda pdf: _handed(pdf, fan), "key string, chunk long, state long")
    return states


def _anchors(window: int, chunk_ms: int, origin: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, part, first, t = _axis(pdf, window, chunk_ms, origin)
        ms, reset = pdf["ms"].to_numpy(dtype=np.int64), pdf["state"].to_numpy(dtype=np.int64)
        stop = np.append(first[1:], len(t))
        anchor = reset - window
        # Events still inside the window a chunk was entered with.
        carried = np.bincount(part, weights=ms <= reset, minlength=len(first)).astype(np.int64)
        at = first + carried
        while True:
            live = np.flatnonzero(at < stop)
            if not len(live):
                break
            here = at[live]
            ends = np.minimum(np.searchsorted(t, t[here] + window, side="right"), stop[live])
            size = ends - here
            rows = np.repeat(here - np.cumsum(size) + size, size) + np.arange(size.sum())
            anchor[rows] = np.repeat(ms[here], size)
            at[live] = ends
        return pd.DataFrame({"key": pdf["key"], "ms": ms, "n": pdf["n"], "anchor": anchor})

    return run


def rate_limit(
    df: DataFrame,
    key: str = "key",
    ts: str = "ts",
    row_id: str = "event_id",
    limit: int = DEFAULTS.rate_limit,
    window_ms: int = DEFAULTS.rate_window_ms,
) -> DataFrame:
    """Mark the events a per-key limit lets through.

    Events without a key share one client of their own. An event without a time
    stands in no window: the limit lets it through, and ``intake`` rejects it.
    """
    # Short chunks for long windows, so that none spans weeks.
    chunk_ms = max(window_ms, min(CHUNK_WINDOWS * window_ms, MAX_CHUNK_MS))
    # A key is told apart from none by its first letter.
    rows = df.withColumns({"_k": F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")), "_ms": F.unix_millis(ts)})
    counts = rows.where("_ms IS NOT NULL").groupBy(F.col("_k").alias("key"), F.col("_ms").alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.withColumn("chunk", F.floor(F.col("ms") / chunk_ms)))
    moments, first, last = counts.agg(F.count(F.lit(1)), F.min("chunk"), F.max("chunk")).first()
    # Chunks count from the first one, so that one block holds them all in the end.
    counts = counts.withColumn("chunk", F.col("chunk") - F.lit(first))
    summary = _calls(counts, ["key", "chunk"], moments).groupBy("call").applyInPandas(
        _chunk_summary(window_ms, chunk_ms, first or 0), "key string, chunk long, entry array<long>, leave array<long>"
    )
    states = _entry_states(summary, (last or 0) - (first or 0) + 1, moments, FAN)
    anchored = (
        _calls(counts.join(states, ["key", "chunk"]), ["key", "chunk"], moments)
        .groupBy("call")
        .applyInPandas(_anchors(window_ms, chunk_ms, first or 0), "key string, ms long, n long, anchor long")
    )
    before = Window.partitionBy("key", "anchor").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    used = anchored.select(
        F.col("key").alias("_k"), F.col("ms").alias("_ms"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_used")
    )
    same = Window.partitionBy("_k", "_ms").orderBy(row_id)
    out = rows.join(used, ["_k", "_ms"]).withColumn("allowed", F.col("_used") + F.row_number().over(same) <= limit)
    untimed = rows.where("_ms IS NULL").withColumn("allowed", F.lit(True))
    return out.drop("_k", "_ms", "_used").unionByName(untimed.drop("_k", "_ms"))


def intake(df: DataFrame, cfg: AuditConfig = DEFAULTS, kind: str = "telemetry") -> DataFrame:
    """The whole chain in its order: rate limit, body, fields, daily cap.

    ``kind`` is telemetry or feedback, each with its own fields and cap; its clients
    have windows of their own. An event without a time is an invalid body. Adds the
    typed fields, ``code`` (NULL when stored) and ``error_field``.
    """
    limited = rate_limit(df, limit=cfg.rate_limit, window_ms=cfg.rate_window_ms)
    judged = judged_bodies(limited, kind, cfg)
    judged = written(judged.withColumns({"code": intake_code(F.col("allowed")), "error_field": F.when(F.col("allowed"), F.col("error_field"))}).drop("allowed", "body_code"))
    capped = daily_cap(judged.where(F.col("code").isNull()), cap_of(kind, cfg))
    stored = capped.withColumn("code", F.when(~F.col("accepted"), LIMITED)).drop("accepted")
    return judged.where(F.col("code").isNotNull()).unionByName(stored)


def intake_code(allowed: Column) -> Column:
    """The answer to a judged event before the daily cap; NULL when it may be stored."""
    return F.when(~allowed, LIMITED).when(F.col("body_code").isNotNull(), F.col("body_code")).when(F.col("error_field").isNotNull(), INVALID)


def cap_of(kind: str, cfg: AuditConfig = DEFAULTS) -> int:
    return cfg.feedback_daily_cap if kind == "feedback" else cfg.telemetry_daily_cap


def counts_by_day_and_band(df: DataFrame, ts: str = "ts") -> DataFrame:
    days = df.groupBy(F.window(ts, "1 day").alias("w"), "band").agg(F.count(F.lit(1)).alias("n"))
    return days.select(utc_day(F.col("w.start")).alias("day"), "band", "n")
