"""Stages of rescheduled candidates, from the slots they booked, the slots of their sessions, and their interviews.

Defined cases: only candidates whose stage is INTERVIEW_RESCHEDULED take part; a source that says nothing of a candidate leaves it to the
next; without any, the candidate has no row.  Ties are broken as the orders below write out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pipeline as p
from . import windows as w

RESCHEDULED = "INTERVIEW_RESCHEDULED"


def resolved(df: DataFrame, names: Sequence[str]) -> str | None:
    """The column that is called by the first of some names, whatever its case and underscores."""
    plain = {c.lower().replace("_", ""): c for c in df.columns}
    return next((plain[n] for n in names if n in plain), None)


def _column(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    found = resolved(df, names)
    return F.col(found).cast(kind) if found else F.lit(None).cast(kind)


def slots_in_common_form(slots: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(candidate, slot_date, slot_time, booked_at) of a table of slots that may name its columns in several ways."""
    return slots.select(
        _column(slots, ("candidateid", "candidate"), "string").alias("candidate"),
        _column(slots, ("slotdate",), "date").alias("slot_date"),
        _column(slots, ("slottime", "time"), "string").alias("slot_time"),
        _column(slots, ("updatedat", "createdat", "bookedat"), "timestamp").alias("booked_at"),
        *extra,
    )


def by_own_slots(cands: DataFrame, slots: DataFrame, interviews: DataFrame, as_of: str, prefix: str) -> DataFrame:
    """(candidate_id, stage): the last slot, if it was booked since the stage was entered.

    One booked before, or at an unknown time, counts too if the interview that was rescheduled was planned for another day or minute.
    ``prefix`` is that of session links, whose interviews hold local time.
    """
    named = p.with_candidate(slots_in_common_form(slots).filter("slot_date is not null"), cands)
    order = [F.col("slot_date").desc(), F.col("slot_time").desc_nulls_first(), F.col("booked_at").desc_nulls_first()]
    last = w.first_per_key(named, ["candidate_id"], order).select("candidate_id", "slot_date", "slot_time", "booked_at")
    moved = interviews.filter(p.plain_status(F.col("status")) == "rescheduled")
    effective = p.effective_schedule(*[F.col(x) for x in ("scheduled_at", "async_link", "meeting_link", "is_async")], prefix)
    planned = w.by_precedence(moved, F.lit("rescheduled")).select("candidate_id", p.local_time(effective).alias("planned"))
    both = cands.select(F.col("id").alias("candidate_id"), "stage_entered_at").join(last, "candidate_id").join(planned, "candidate_id", "left")
    since = F.coalesce(F.col("booked_at") >= F.col("stage_entered_at"), F.lit(False))
    same_time = F.coalesce(F.substring("slot_time", 1, 5) == F.date_format("planned", "HH:mm"), F.lit(True))
    moved_on = F.col("planned").isNotNull() & ~((F.col("slot_date") == F.to_date("planned")) & same_time)
    stage = F.when(since | moved_on, p.slot_stage(F.col("slot_date"), as_of))
    return both.select("candidate_id", stage.alias("stage")).filter("stage is not null")


def by_session_slots(cands: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """(candidate_id, stage): the last slot of a session, from today on, that was not booked before the stage was entered."""
    both = sessions.join(cands.select(F.col("id").alias("candidate_id"), "stage_entered_at"), "candidate_id").withColumn("stage", p.slot_stage(F.col("slot_date"), as_of))
    open_ = both.filter(F.col("stage").isNotNull() & ~F.coalesce(F.col("booked_at") < F.col("stage_entered_at"), F.lit(False)))
    order = [F.col("slot_date").desc(), F.col("slot_time").desc_nulls_first(), F.col("booked_at").desc_nulls_first()]
    return w.first_per_key(open_, ["candidate_id"], order).select("candidate_id", "stage")


def by_interviews(cands: DataFrame, interviews: DataFrame, as_of: str) -> DataFrame:
    """(candidate_id, stage): the interview with precedence, of those made since the stage was entered, by its timing."""
    both = interviews.join(cands.select(F.col("id").alias("candidate_id"), "stage_entered_at"), "candidate_id")
    made = F.coalesce("created_at", "scheduled_at")
    since = both.filter(~F.coalesce(made < F.col("stage_entered_at"), F.lit(False)))
    best = w.by_precedence(since, p.canonical_status(F.col("status")))
    bucket = p.timing_bucket(F.col("status"), F.col("scheduled_at"), as_of)
    stage = F.when(bucket == "today", "INTERVIEWED").when(bucket == "future", "INTERVIEW_SCHEDULED")
    return best.select("candidate_id", stage.alias("stage")).filter("stage is not null")


def synced(cands: DataFrame, slots: DataFrame, sessions: DataFrame, interviews: DataFrame, as_of: str, prefix: str) -> DataFrame:
    """(candidate_id, stage, via): the stage of each rescheduled candidate by the first source that has one.

    The three sources are put together by one grouping, not by joins one after the other.
    """
    own = cands.filter(F.col("stage") == RESCHEDULED).select("id", "code", "stage_entered_at")
    sources = (("slot", by_own_slots(own, slots, interviews, as_of, prefix)), ("session", by_session_slots(own, sessions, as_of)), ("interview", by_interviews(own, interviews, as_of)))
    rows = None
    for rank, (name, found) in enumerate(sources):
        part = found.select("candidate_id", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("via"), "stage").alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("candidate_id").agg(F.min("s").alias("s")).select("candidate_id", "s.stage", "s.via")
