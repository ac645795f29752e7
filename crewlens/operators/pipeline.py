"""The pipeline's state machine as column expressions, interview timing, and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CANDIDATE_OWNED, DEFAULT_THRESHOLD, GRACE_MINUTES, LEGACY_STAGES, LOCAL_OFFSET, PASS_SCORE, STAGES, STATUS_ALIASES


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def current_stage(stage: Column) -> Column:
    """Legacy stages replaced; unknown ones become REVIEW."""
    mapped = F.coalesce(literal_map(LEGACY_STAGES)[stage], stage)
    return F.when(stage.isNull(), None).when(mapped.isin(*STAGES), mapped).otherwise("REVIEW")


def canonical_status(status: Column) -> Column:
    """Lower case, spaces and hyphens as underscores, aliases resolved."""
    plain = F.regexp_replace(F.trim(F.lower(F.coalesce(status, F.lit("")))), r"[\s-]+", "_")
    return F.coalesce(literal_map(STATUS_ALIASES)[plain], plain)


def plain_status(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit(""))))


def out_of_ten(score: Column) -> Column:
    """Scores above ten are percentages."""
    return F.when(score > 10, score / 10).otherwise(score)


def interview_stage(status: Column, score: Column) -> Column:
    """The stage that an interview alone stands for; null if none."""
    s = plain_status(status)
    passed = F.coalesce(out_of_ten(score), F.lit(0.0)) >= PASS_SCORE
    return (
        F.when(s == "completed", F.when(passed, "SELECTED").otherwise("REJECTED"))
        .when(s == "ongoing", "INTERVIEWED")
        .when(s == "scheduled", "INTERVIEW_SCHEDULED")
    )


def _low_resume(resume_score: Column, threshold: Column) -> Column:
    t = F.coalesce(F.nullif(threshold, F.lit(0.0)), F.lit(float(DEFAULT_THRESHOLD)))
    return F.coalesce(resume_score <= t - 10, F.lit(False))


def display_stage(stage: Column, status: Column, resume_score: Column, threshold: Column) -> Column:
    """Stages that the candidate owns win, then the latest interview, then a low résumé score."""
    s = plain_status(status)
    return (
        F.when(stage.isin(*CANDIDATE_OWNED), stage)
        .when(s.isin("completed", "ongoing"), "INTERVIEWED")
        .when(s == "scheduled", "INTERVIEW_SCHEDULED")
        .when(_low_resume(resume_score, threshold), "RESUME_REJECTED")
        .otherwise(stage)
    )


def reporting_stage(stage: Column, status: Column, score: Column, resume_score: Column, threshold: Column) -> Column:
    """The display stage with outcomes of interviews; a low résumé score alone leaves the stored stage."""
    s = plain_status(status)
    shown = display_stage(stage, status, resume_score, threshold)
    passed = F.coalesce(out_of_ten(score), F.lit(0.0)) >= PASS_SCORE
    return (
        F.when(stage.isin(*CANDIDATE_OWNED), stage)
        .when(s == "selected", "SELECTED")
        .when(s == "rejected", "REJECTED")
        .when(s == "completed", F.when(passed, "SELECTED").otherwise("REJECTED"))
        .when(shown == "RESUME_REJECTED", stage)
        .otherwise(shown)
    )


def slot_backed_stage(stage: Column, shown: Column, slot_stage: Column) -> Column:
    return F.when(stage.isin(*CANDIDATE_OWNED), stage).otherwise(F.coalesce(slot_stage, shown))


def rejected_stage(stage: Column, shown: Column, status: Column, scheduled_at: Column, resume_score: Column, threshold: Column, as_of: str) -> Column:
    """What a candidate shown as rejected is, by its latest interview, its résumé score and its stage."""
    s = plain_status(status)
    today = timing_bucket(F.lit("scheduled"), scheduled_at, as_of) == "today"
    return (
        F.when(shown != "REJECTED", shown)
        .when(s == "rejected", "REJECTED")
        .when(s.isin("completed", "ongoing"), "INTERVIEWED")
        .when(s.isin("scheduled", "rescheduled"), F.when(today, "INTERVIEWED").otherwise("INTERVIEW_SCHEDULED"))
        .when(_low_resume(resume_score, threshold), "RESUME_REJECTED")
        .when(stage.isin("REVIEW", "SHORTLISTED", "INTERVIEW_RESCHEDULED", "NO_SHOW", "SELECTED"), stage)
        .otherwise("SHORTLISTED")
    )


def local_time(ts: Column) -> Column:
    """Local wall-clock time of the slots, at a fixed offset from UTC."""
    return F.from_utc_timestamp(ts, LOCAL_OFFSET)


def local_now(as_of: str) -> Column:
    return local_time(F.lit(as_of).cast("timestamp"))


def effective_schedule(scheduled_at: Column, async_link: Column, meeting_link: Column, is_async: Column, prefix: str) -> Column:
    """Schedules of session links without a meeting hold local wall-clock time; others UTC."""
    link = F.trim(F.coalesce(async_link, F.lit("")))
    legacy = link.startswith(prefix) & (F.trim(F.coalesce(meeting_link, F.lit(""))) == "") & ~F.coalesce(is_async, F.lit(False))
    return F.when(legacy, F.to_utc_timestamp(scheduled_at, LOCAL_OFFSET)).otherwise(scheduled_at)


def timing_bucket(status: Column, scheduled_at: Column, as_of: str) -> Column:
    """'today', 'future' or null by local day, with a grace period after the start."""
    s = canonical_status(status)
    local, now = local_time(scheduled_at), local_now(as_of)
    return (
        F.when(s.isin("completed", "ongoing"), "today")
        .when(~s.isin("scheduled", "rescheduled"), None)
        .when(scheduled_at.isNull(), "future")
        .when(F.to_date(local) < F.to_date(now), None)
        .when(F.to_date(local) > F.to_date(now), "future")
        .when(local + F.expr(f"interval {GRACE_MINUTES} minutes") > now, "today")
    )


def slot_within_window(slot_date: Column, slot_time: Column, as_of: str) -> Column:
    """Whether a slot has not begun longer ago than the grace period; without a time it has not."""
    cutoff = F.date_trunc("minute", local_now(as_of) - F.expr(f"interval {GRACE_MINUTES} minutes"))
    start = F.to_timestamp(F.concat_ws(" ", slot_date.cast("string"), slot_time))
    return F.when(slot_date.isNull(), False).when(slot_time.isNull(), True).otherwise(start > cutoff)


def slot_stage(slot_date: Column, as_of: str) -> Column:
    """A slot today stands for an interview under way, a later one for a scheduled one."""
    today = F.to_date(local_now(as_of))
    return F.when(slot_date == today, "INTERVIEWED").when(slot_date > today, "INTERVIEW_SCHEDULED")


def listing_stage(stage: Column, slot_date: Column, bucket: Column, as_of: str) -> Column:
    """The stage that the listing shows: a coming slot decides, else the timing of the interview; a rescheduled one stays."""
    timed = F.when(bucket == "today", "INTERVIEWED").when(bucket == "future", "INTERVIEW_SCHEDULED")
    return F.when(stage == "INTERVIEW_RESCHEDULED", stage).otherwise(F.coalesce(slot_stage(slot_date, as_of), timed, stage))


def stage_from_score(stage: Column, score: Column, stored: Column, threshold: Column, has_job: Column) -> Column:
    """Bands of the résumé score around the threshold; a no-show stays one."""
    t = F.coalesce(F.nullif(threshold, F.lit(0.0)), F.lit(float(DEFAULT_THRESHOLD)))
    s = F.coalesce(score, stored)
    return (
        F.when(stage == "NO_SHOW", stage)
        .when(s.isNull(), F.when(has_job, "REVIEW").otherwise("APPLIED"))
        .when(s >= t, "SHORTLISTED")
        .when(s > t - 10, "REVIEW")
        .otherwise("RESUME_REJECTED")
    )


def slot_keys(df: DataFrame, id_column: str, code_column: str) -> DataFrame:
    """(id, key): the spellings by which a slot may name a candidate, lower-cased, with and without braces."""
    text = F.array(F.col(id_column).cast("string"), F.col(code_column))
    plain = F.filter(F.transform(text, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    both = F.concat(plain, F.transform(plain, lambda x: F.concat(F.lit("{"), x, F.lit("}"))))
    return df.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(both)).alias("key"))


def with_candidate(slots: DataFrame, cands: DataFrame) -> DataFrame:
    """Slots with the ``candidate_id`` that their spelling names; slots of nobody are left out."""
    keys = slot_keys(cands, "id", "code").withColumnRenamed("id", "candidate_id")
    return slots.withColumn("key", F.lower(F.trim("candidate"))).join(keys, "key").drop("key")
