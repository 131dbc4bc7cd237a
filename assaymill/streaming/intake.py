"""Structured Streaming form of event intake.

Every query keeps its checkpoint beside its output and writes files named after
the batch: a repeated batch replaces its own output, and a query that is started
again on the same folder goes on where it stopped, with its caps and limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.operators import events as E


def stamped(events: DataFrame, arrival: str = "ts") -> DataFrame:
    """Arrival time is the server's clock; what the client claims is ignored."""
    return events.withColumn(arrival, F.current_timestamp())


def _run(stream: DataFrame, folder: str, each, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def route(bodies: DataFrame, folder: str, cfg: AuditConfig = DEFAULTS) -> None:
    """Validate each body and store it as accepted or rejected with its code."""
    judged = E.judged_bodies(bodies, cfg=cfg).withColumn("code", E.intake_code(F.lit(True))).drop("body_code")

    def each(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("accepted", F.col("code").isNull())
        marked.write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/batch={number}")

    _run(judged, folder, each)


def routed(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def capped(events: DataFrame, folder: str, cap: int) -> None:
    """Accept the first rows of each UTC day across batches.

    A small running table holds what each day has taken so far; a batch reads the
    one its predecessor wrote and never looks at stored rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        used = spark.read.parquet(f"{folder}/taken/batch={number - 1}") if number > 0 else None
        rows = f"{folder}/rows/batch={number}"
        E.daily_cap(batch, cap, used=used).write.mode("overwrite").parquet(rows)
        taken = spark.read.parquet(rows).where("accepted").groupBy(E.utc_day(F.col("ts")).alias("day")).agg(
            F.count(F.lit(1)).alias("n")
        )
        if used is not None:
            taken = taken.unionByName(used).groupBy("day").agg(F.sum("n").alias("n"))
        taken.write.mode("overwrite").parquet(f"{folder}/taken/batch={number}")

    _run(events, folder, each)


def counted(events: DataFrame, folder: str, late: str = "1 day") -> None:
    """Counts per day and band, kept as one partition per day.

    A batch brings the counts that it changed, and replaces the partitions of those days
    alone; a day behind the watermark leaves the state. So state and output of a batch
    depend on the days it touches, not on all days so far. A partition is written with
    the bands its day already had, and a repeated batch writes the same again.
    """
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "band").agg(
        F.count(F.lit(1)).alias("n")
    )
    table = days.select(E.utc_day(F.col("w.start")).alias("day"), "band", "n")
    path = f"{folder}/days"

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = f"{folder}/changed/batch={number}"
        batch.write.mode("overwrite").parquet(fresh)
        changed = session.read.schema(batch.schema).parquet(fresh)
        touched = [r[0] for r in changed.select("day").distinct().collect()]  # days of one batch
        if not touched:
            return
        merged = changed
        try:
            known = newest(session, folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            bands = known.where(F.col("day").isin(touched)).alias("a").join(changed.alias("b"), (F.col("a.day") == F.col("b.day")) & F.col("a.band").eqNullSafe(F.col("b.band")), "left_anti")
            merged = changed.unionByName(bands)
        whole = f"{folder}/merged/batch={number}"
        merged.write.mode("overwrite").parquet(whole)
        new = session.read.schema(merged.schema).parquet(whole)
        new.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    _run(table, folder, each, "update")


def newest(spark, folder: str) -> DataFrame:
    """The table that ``counted`` keeps."""
    return spark.read.schema("band string, n long, day string").parquet(f"{folder}/days").select("day", "band", "n")


def limited(events: DataFrame, limit: int, window_ms: int, late: str = "1 minute") -> DataFrame:
    """Per-key limit as a stateful stream.

    State is the end of the open window and the events it has taken. A key whose
    window has closed below the watermark is forgotten.
    """

    # NULL is a key of its own, as in the batch form.
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, used = state.get if state.exists else (E.START, 0)
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["ms", "event_id"], ignore_index=True)
        ms = rows["ms"].to_numpy(dtype=np.int64)
        allowed, reset, used = _allowed(ms, reset, used, limit, window_ms)
        state.update((reset, used))
        state.setTimeoutTimestamp(max(reset, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "allowed": allowed})

    keyed = events.where("ts IS NOT NULL").withWatermark("ts", late).select("key", "event_id", "ts", F.unix_millis("ts").alias("ms"))
    # As in the batch form, an event without a time stands in no window.
    untimed = events.where("ts IS NULL").select("key", "event_id", F.lit(True).alias("allowed"))
    timed = keyed.groupBy("key").applyInPandasWithState(
        step,
        "key string, event_id long, allowed boolean",
        "reset long, used long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return timed.unionByName(untimed)


class _WindowLimit(StatefulProcessor):
    """The open window of one client: when it ends, and what it has taken.

    A timer at the window's end forgets the client once the watermark is past it, so
    the store holds the clients of open windows only. Clients are many and have few events
    each: a frame is answered in place, with as few columns and calls as it takes.
    """

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", T.StructType([T.StructField("reset", T.LongType()), T.StructField("used", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reset, used = self.window.get() or (E.START, 0)  # None for a client without a window
        entered = reset
        parts = list(rows)
        batch = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        ms = batch["us"].to_numpy(dtype=np.int64) // 1000
        order = np.lexsort((batch["event_id"].to_numpy(), ms))
        allowed = np.empty(len(ms), bool)
        allowed[order], reset, used = _allowed(ms[order], reset, used, self.limit, self.window_ms)
        self.window.update((reset, used))
        if reset != entered:
            if entered != E.START:
                self.handle.deleteTimer(entered)
            self.handle.registerTimer(reset)
        batch["allowed"] = allowed
        yield batch

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def _allowed(ms: np.ndarray, reset: int, used: int, limit: int, window_ms: int) -> tuple[np.ndarray, int, int]:
    """Which of a client's events, in order of time, its limit lets through; and the window left open."""
    at = int(np.searchsorted(ms, reset, side="right"))
    allowed = np.empty(len(ms), bool)
    allowed[:at] = used + np.arange(1, at + 1) <= limit
    used += at
    while at < len(ms):  # one step per window, not per row
        reset = int(ms[at]) + window_ms
        end = int(np.searchsorted(ms, reset, side="right"))
        used = end - at
        allowed[at:end] = np.arange(1, used + 1) <= limit
        at = end
    return allowed, reset, used


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def intake(events: DataFrame, folder: str, kind: str = "telemetry", cfg: AuditConfig = DEFAULTS, late: str = "1 minute") -> None:
    """The whole chain on a stream of (event_id, key, ts, body): limit, body, fields, daily cap.

    Bodies are parsed before the state, so the state sees typed fields and no body. The
    limit is kept per client in the state store; the cap, which belongs to a day and not
    to a client, in a small table that each batch reads from its predecessor and writes
    anew. A batch that is repeated replaces its own output. All rows of one client in one
    batch are sorted in one task: bound a batch with the source's own options.
    """
    spark = events.sparkSession
    judged = E.judged_bodies(events, kind, cfg)
    fields = [c for c in judged.columns if c not in ("key", "ts", "body")]
    keyed = judged.where("ts IS NOT NULL").withWatermark("ts", late)
    # NULL is a client of its own, and told apart from any name by the first letter.
    client = F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("")).alias("client")
    # What the limit does not look at travels as one text: a column costs the state more than it does JSON.
    carried = [c for c in ("key", *fields) if c != "event_id"]
    slim = keyed.select(client, "ts", F.unix_micros("ts").alias("us"), "event_id", F.to_json(F.struct(*carried), MICROS).alias("carried"))
    schema = T.StructType([*[slim.schema[c] for c in ("us", "event_id", "carried")], T.StructField("allowed", T.BooleanType())])
    answers = slim.groupBy("client").transformWithStateInPandas(_WindowLimit(cfg.rate_limit, cfg.rate_window_ms), schema, "Append", "eventTime")
    limited = answers.select(F.timestamp_micros("us").alias("ts"), "event_id", "allowed", F.from_json("carried", judged.select(*carried).schema, MICROS).alias("c")).select("c.*", "ts", "event_id", "allowed")
    untimed = judged.where("ts IS NULL").select(*carried, "ts", "event_id", F.lit(True).alias("allowed"))
    answered = limited.unionByName(untimed).withColumns({"code": E.intake_code(F.col("allowed")), "error_field": F.when(F.col("allowed"), F.col("error_field"))}).drop("allowed", "body_code")

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # Written first: every action on the batch would run the stateful step again.
        batch.write.mode("overwrite").parquet(f"{folder}/answered/batch={number}")
        rows = session.read.schema(batch.schema).parquet(f"{folder}/answered/batch={number}")
        used = session.read.parquet(f"{folder}/taken/batch={number - 1}") if number > 0 else None
        capped = E.daily_cap(rows.where("code IS NULL"), E.cap_of(kind, cfg), used=used)
        stored = capped.withColumn("code", F.when(~F.col("accepted"), E.LIMITED)).drop("accepted")
        done = rows.where("code IS NOT NULL").unionByName(stored)
        done.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        taken = session.read.schema(done.schema).parquet(f"{folder}/rows/batch={number}").where("code IS NULL")
        days = taken.groupBy(E.utc_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        if used is not None:
            days = days.unionByName(used).groupBy("day").agg(F.sum("n").alias("n"))
        days.write.mode("overwrite").parquet(f"{folder}/taken/batch={number}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        _run(answered, folder, each)
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def taken_in(spark, folder: str) -> DataFrame:
    """All events of an intake stream with their ``code``."""
    return spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").drop("batch")


def store(stream: DataFrame, folder: str) -> None:
    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    _run(stream, folder, each)
