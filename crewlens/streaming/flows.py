"""Streams of events: duplicates in a time window, usage windows, sessions, no-show timers, stage changes.

Each function takes a frame, streaming or not where that is possible, and returns one; callers choose trigger and
sink.  Event time is ``ts`` and every watermark is an argument, so late rows are dropped the same way everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files at a path; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def json_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of posted events, one JSON object a line, in the files of a folder."""
    return spark.readStream.schema(schema).json(folder)


def with_event_time(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def without_repeats(df: DataFrame, keys: list[str], within: str = "180 seconds") -> DataFrame:
    """A stream without rows whose key came within the time before; state leaves with the watermark."""
    return with_event_time(df, within).dropDuplicatesWithinWatermark(keys)


def usage_windows(df: DataFrame, keys: list[str], amount: str, length: str = "30 days", late: str = "1 day") -> DataFrame:
    """(keys, start, used, n) of tumbling windows: the counters of a cycle."""
    w = F.window("ts", length)
    out = with_event_time(df, late).groupBy(w.alias("w"), *keys).agg(F.sum(amount).alias("used"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "used", "n")


def sliding_counts(df: DataFrame, keys: list[str], length: str = "1 hour", every: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    out = with_event_time(df, late).groupBy(F.window("ts", length, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of events with no longer pause than the gap."""
    out = with_event_time(df, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Two to this power is how many neighbouring ids of candidates share a group of state.
TOGETHER = 10


def _micros(times: pd.Series) -> list[int | None]:
    """Microseconds since 1970, None for null."""
    plain = times if times.dt.tz is None else times.dt.tz_convert("UTC").dt.tz_localize(None)
    return [None if null else x for x, null in zip(plain.astype("datetime64[us]").astype("int64").tolist(), plain.isna().tolist(), strict=True)]


def no_shows(df: DataFrame, grace_minutes: int = 30, late: str = "1 minute") -> DataFrame:
    """(candidate_id, stage) of a stream of (candidate_id, status, scheduled_at, ts): a timer for each scheduled interview.

    A candidate whose interview has not started ``grace_minutes`` after its time, by the watermark, is a no-show; a later
    start or end before that cancels the timer.  Neighbouring ids share a group (``TOGETHER``), since a call of a group costs more than
    its rows do; the group's timer is that of its first interview, and a candidate leaves the state when it fires or is cancelled.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {c: (due, at) for c, due, at in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            for part in rows:  # parts come in any order; the latest row of a candidate decides
                cols = (part["candidate_id"].tolist(), part["status"].tolist(), _micros(part["scheduled_at"]), _micros(part["ts"]))
                for c, status, planned, at in zip(*cols, strict=True):
                    c = None if key[0] is None else c  # without an id they are one
                    if at is not None and (c not in held or at >= held[c][1]):
                        waits = status in ("scheduled", "rescheduled") and planned is not None
                        held[c] = (planned + grace_minutes * 60_000_000 if waits else None, at)
        now = state.getCurrentWatermarkMs() * 1000
        gone = [c for c, (due, _) in held.items() if due is not None and due <= now]
        left = {c: x for c, x in held.items() if x[0] is not None and x[0] > now}
        if left:
            state.update((list(left), [due for due, _ in left.values()], [at for _, at in left.values()]))
            # in whole milliseconds, the next one where the time has a part of one
            state.setTimeoutTimestamp(-(-min(due for due, _ in left.values()) // 1000))
        elif state.exists:
            state.remove()
        if gone:
            yield pd.DataFrame({"candidate_id": pd.array(gone, dtype="Int64"), "stage": "NO_SHOW"})

    timed = with_event_time(df, late).withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp"))
    held = "ids array<long>, due array<long>, at array<long>"
    grouped = timed.withColumn("part", F.shiftright("candidate_id", TOGETHER)).groupBy("part")
    return grouped.applyInPandasWithState(step, "candidate_id long, stage string", held, "append", GroupStateTimeout.EventTimeTimeout)


# E-mails that move a candidate.
MAIL_STAGES = {"shortlist_mail": "SHORTLISTED", "rejection_mail": "REJECTED", "interview_invite": "INTERVIEW_SCHEDULED"}


def mail_stages(df: DataFrame) -> DataFrame:
    """(candidate_id, stage, ts) of sent e-mails that move a candidate; no state is kept."""
    to = F.create_map(*[F.lit(x) for kv in MAIL_STAGES.items() for x in kv])
    moved = df.filter(F.lower("status") == "sent").withColumn("stage", F.try_element_at(to, F.lower("email_type")))
    return moved.filter("stage is not null").select("candidate_id", "stage", "ts")


def into_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now into Parquet files, exactly once, and stop; run again it goes on where it ended."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts_into(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that each batch has changed, in a partition of their own that a repeated batch replaces; read by ``latest``.

    State holds only what the watermark still admits, and no batch rewrites what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, schema: StructType, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that ``upserts_into`` has written."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
