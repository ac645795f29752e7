"""Queries of the state machine, interview timing, slots and joins on keys with several spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pipeline as p
from ..operators import windows as w
from ..sources import views as v
from .sql_views import Register

register = Register()
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scheduled_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id DESC) AS rn FROM interviews) WHERE rn = 1)"
OWNED = "('REVIEW', 'SHORTLISTED', 'RESUME_REJECTED', 'INTERVIEW_RESCHEDULED', 'NO_SHOW')"
DISPLAY = f"""CASE WHEN stage IN {OWNED} THEN stage WHEN lower(trim(coalesce(status, ''))) IN ('completed', 'ongoing') THEN 'INTERVIEWED'
  WHEN lower(trim(coalesce(status, ''))) = 'scheduled' THEN 'INTERVIEW_SCHEDULED'
  WHEN resume_score <= coalesce(nullif(score_threshold, 0), 60) - 10 THEN 'RESUME_REJECTED' ELSE stage END"""
TEN = "CASE WHEN interview_score > 10 THEN interview_score / 10 ELSE interview_score END"
REPORTING = f"""CASE WHEN stage IN {OWNED} THEN stage WHEN lower(trim(coalesce(status, ''))) = 'selected' THEN 'SELECTED'
  WHEN lower(trim(coalesce(status, ''))) = 'rejected' THEN 'REJECTED'
  WHEN lower(trim(coalesce(status, ''))) = 'completed' THEN CASE WHEN coalesce({TEN}, 0) >= 6 THEN 'SELECTED' ELSE 'REJECTED' END
  WHEN ({DISPLAY}) = 'RESUME_REJECTED' THEN stage ELSE {DISPLAY} END"""
BOTH = "both_ AS (SELECT c.id, c.stage, c.resume_score, c.score_threshold, l.status, l.interview_score, l.scheduled_at FROM candidates c LEFT JOIN latest l ON l.candidate_id = c.id)"
CANON = "CASE regexp_replace(trim(lower(coalesce(status, ''))), '[\\s-]+', '_', 'g') WHEN 'in_progress' THEN 'ongoing' WHEN 'inprogress' THEN 'ongoing' WHEN 'noshow' THEN 'no_show' ELSE regexp_replace(trim(lower(coalesce(status, ''))), '[\\s-]+', '_', 'g') END"
LOCAL_NOW = "(TIMESTAMP '2001-08-01 06:30:00' + INTERVAL 330 MINUTE)"
TIMING = """CASE WHEN {s} IN ('completed', 'ongoing') THEN 'today' WHEN {s} NOT IN ('scheduled', 'rescheduled') THEN NULL WHEN {at} IS NULL THEN 'future'
  WHEN CAST({at} + INTERVAL 330 MINUTE AS DATE) < CAST({now} AS DATE) THEN NULL WHEN CAST({at} + INTERVAL 330 MINUTE AS DATE) > CAST({now} AS DATE) THEN 'future'
  WHEN {at} + INTERVAL 360 MINUTE > {now} THEN 'today' END"""
SLOT_OF = """keyed AS (SELECT id AS candidate_id, unnest([CAST(id AS VARCHAR), lower(code), '{' || id || '}', '{' || lower(code) || '}']) AS key FROM candidates),
slot_of AS (SELECT s.*, k.candidate_id FROM slots s JOIN keyed k ON lower(trim(s.candidate)) = k.key)"""


def both(spark, d):
    """Candidates with their latest interview."""
    last = w.latest_interview(v.interviews(spark, d)).select("candidate_id", "status", "interview_score", "scheduled_at")
    c = v.candidates(spark, d)
    return c.join(last, c["id"] == last["candidate_id"], "left")


def _display():
    return p.display_stage(F.col("stage"), F.col("status"), F.col("resume_score"), F.col("score_threshold"))


def _reporting():
    return p.reporting_stage(*[F.col(c) for c in ("stage", "status", "interview_score", "resume_score", "score_threshold")])


@register(f"WITH {LATEST} SELECT candidate_id, id, status FROM latest")
def w1_latest_interview(spark, d):
    return w.latest_interview(v.interviews(spark, d)).select("candidate_id", "id", "status")


@register("SELECT candidate_id, id FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM messages) WHERE rn = 1")
def w2_newest_message(spark, d):
    m = w.first_per_key(v.messages(spark, d), ["candidate_id"], [F.col("created_at").desc(), F.col("id").desc()])
    return m.select("candidate_id", "id")


@register("""SELECT candidate, id, CAST(slot_date AS VARCHAR) AS slot_date FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY slot_date, slot_time NULLS LAST, id) AS rn
  FROM slots WHERE slot_date >= DATE '1998-06-01') WHERE rn = 1""")
def w3_next_slot(spark, d):
    return w.next_slot(v.slots(spark, d), "candidate", "1998-06-01").select("candidate", "id", F.col("slot_date").cast("string").alias("slot_date"))


@register("""SELECT candidate, id FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY slot_date DESC, slot_time DESC NULLS FIRST, created_at DESC, id) AS rn FROM slots) WHERE rn = 1""")
def w4_last_slot(spark, d):
    return w.last_slot(v.slots(spark, d), "candidate").select("candidate", "id")


@register("""SELECT candidate_id, min(id) AS id FROM interviews i WHERE created_at = (SELECT min(created_at) FROM interviews x WHERE x.candidate_id = i.candidate_id) GROUP BY candidate_id""")
def w5_first_after_order(spark, d):
    return w.first_per_key(v.interviews(spark, d), ["candidate_id"], [F.col("created_at"), F.col("id")]).select("candidate_id", "id")


@register(f"""
SELECT candidate_id, id, s AS status FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(scheduled_at, created_at) DESC,
  created_at DESC, CASE s WHEN 'rescheduled' THEN 0 WHEN 'scheduled' THEN 1 WHEN 'ongoing' THEN 2 WHEN 'completed' THEN 3 WHEN 'no_show' THEN 3 WHEN 'selected' THEN 4 WHEN 'rejected' THEN 4 ELSE 1 END DESC, id) AS rn
  FROM (SELECT *, {CANON} AS s FROM interviews)) WHERE rn = 1""")
def w6_precedence_argmax(spark, d):
    i = v.interviews(spark, d).withColumn("status", p.canonical_status(F.col("status")))
    return w.by_precedence(i, F.col("status")).select("candidate_id", "id", "status")


@register("""
WITH x AS (SELECT candidate_id % 500 AS k, CAST(created_at AS DATE) AS a, CAST(created_at AS DATE) + CAST(5 AS INT) AS b FROM interviews),
y AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
z AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM y)
SELECT k, CAST(min(a) AS VARCHAR) AS a, CAST(max(b) AS VARCHAR) AS b, count(*) AS pieces FROM z GROUP BY k, g""")
def w8_merge_intervals(spark, d):
    x = v.interviews(spark, d).select((F.col("candidate_id") % 500).alias("k"), F.to_date("created_at").alias("a"))
    merged = w.merge_intervals(x.withColumn("b", F.date_add("a", 5)), "k", "a", "b")
    return merged.select("k", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "pieces")


@register("SELECT user_id, id, lead(id) OVER (PARTITION BY user_id ORDER BY ts, id) AS next_id FROM activity")
def w9_consecutive_pairs(spark, d):
    from pyspark.sql import Window as W

    return v.activity(spark, d).select("user_id", "id", F.lead("id").over(W.partitionBy("user_id").orderBy("ts", "id")).alias("next_id"))


@register("""SELECT agency_id, id FROM (SELECT *, row_number() OVER (PARTITION BY agency_id ORDER BY CASE WHEN role = 'admin' AND is_active THEN 0 ELSE 1 END, created_at, id) AS rn FROM users) WHERE rn = 1""")
def w10_scope_owner(spark, d):
    first = F.when((F.col("role") == "admin") & F.col("is_active"), 0).otherwise(1)
    return w.first_per_key(v.users(spark, d), ["agency_id"], [first, F.col("created_at"), F.col("id")]).select("agency_id", "id")


@register(f"""SELECT id, CASE WHEN stage IN ('INTERVIEW_REVIEW') THEN 'INTERVIEWED' WHEN stage = 'INTERVIEW_FAILED' THEN 'REJECTED' WHEN stage = 'OFFER_MADE' THEN 'SELECTED' ELSE stage END AS stage FROM candidates""")
def k2_legacy_stage(spark, d):
    return v.candidates(spark, d).select("id", p.current_stage(F.col("stage")).alias("stage"))


@register("""SELECT c.id, coalesce(c.agency_id, j.agency_id, a.agency_id, b.agency_id) AS agency_id FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id LEFT JOIN users a ON a.id = c.assigned_to LEFT JOIN users b ON b.id = c.created_by""")
def k3_scope_backfill(spark, d):
    c = v.candidates(spark, d).select("id", "job_id", "assigned_to", "created_by", "agency_id")
    j = v.jobs(spark, d).select(F.col("id").alias("job_id"), F.col("agency_id").alias("_j"))
    u = v.users(spark, d)
    a, b = u.selectExpr("id as assigned_to", "agency_id as _a"), u.selectExpr("id as created_by", "agency_id as _b")
    full = c.join(j, "job_id", "left").join(a, "assigned_to", "left").join(b, "created_by", "left")
    return full.select("id", F.coalesce("agency_id", "_j", "_a", "_b").alias("agency_id"))


@register(f"""SELECT id, CASE lower(trim(coalesce(status, ''))) WHEN 'completed' THEN CASE WHEN coalesce({TEN}, 0) >= 6 THEN 'SELECTED' ELSE 'REJECTED' END WHEN 'ongoing' THEN 'INTERVIEWED' WHEN 'scheduled' THEN 'INTERVIEW_SCHEDULED' END AS stage FROM interviews""")
def p1_interview_stage(spark, d):
    return v.interviews(spark, d).select("id", p.interview_stage(F.col("status"), F.col("interview_score")).alias("stage"))


@register(f"WITH {LATEST}, {BOTH} SELECT id, {DISPLAY} AS shown FROM both_")
def p2_display_stage(spark, d):
    return both(spark, d).select("id", _display().alias("shown"))


@register(f"WITH {LATEST}, {BOTH} SELECT id, {REPORTING} AS reported FROM both_")
def p3_reporting_stage(spark, d):
    return both(spark, d).select("id", _reporting().alias("reported"))


@register(f"""
WITH {SLOT_OF}, nxt AS (SELECT candidate_id, slot_date FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY slot_date, slot_time NULLS LAST, id) AS rn FROM slot_of WHERE slot_date >= DATE '2001-08-01') WHERE rn = 1),
{LATEST}, {BOTH}, s AS (SELECT b.*, {DISPLAY} AS shown, CASE WHEN n.slot_date = DATE '2001-08-01' THEN 'INTERVIEWED' WHEN n.slot_date > DATE '2001-08-01' THEN 'INTERVIEW_SCHEDULED' END AS ss FROM both_ b LEFT JOIN nxt n ON n.candidate_id = b.id)
SELECT id, CASE WHEN stage IN {OWNED} THEN stage ELSE coalesce(ss, shown) END AS stage_now FROM s""")
def p4_slot_backed_stage(spark, d):
    booked = p.with_candidate(v.slots(spark, d), v.candidates(spark, d))
    nxt = w.next_slot(booked, "candidate_id", "2001-08-01").selectExpr("candidate_id as _c", "slot_date")
    b = both(spark, d).withColumn("shown", _display())
    full = b.join(nxt, b["id"] == nxt["_c"], "left")
    return full.select("id", p.slot_backed_stage(F.col("stage"), F.col("shown"), p.slot_stage(F.col("slot_date"), v.AS_OF)).alias("stage_now"))


@register(f"""WITH {LATEST}, {BOTH}, s AS (SELECT *, {REPORTING} AS shown, {TIMING.format(s="'scheduled'", at='scheduled_at', now=LOCAL_NOW)} AS t FROM both_)
SELECT id, CASE WHEN shown <> 'REJECTED' THEN shown WHEN lower(trim(coalesce(status, ''))) = 'rejected' THEN 'REJECTED' WHEN lower(trim(coalesce(status, ''))) IN ('completed', 'ongoing') THEN 'INTERVIEWED'
  WHEN lower(trim(coalesce(status, ''))) IN ('scheduled', 'rescheduled') THEN CASE WHEN t = 'today' THEN 'INTERVIEWED' ELSE 'INTERVIEW_SCHEDULED' END
  WHEN resume_score <= coalesce(nullif(score_threshold, 0), 60) - 10 THEN 'RESUME_REJECTED' WHEN stage IN ('REVIEW', 'SHORTLISTED', 'INTERVIEW_RESCHEDULED', 'NO_SHOW', 'SELECTED') THEN stage ELSE 'SHORTLISTED' END AS resolved FROM s""")
def p5_rejected_stage(spark, d):
    b = both(spark, d).withColumn("shown", _reporting())
    out = p.rejected_stage(*[F.col(c) for c in ("stage", "shown", "status", "scheduled_at", "resume_score", "score_threshold")], as_of=v.AS_OF)
    return b.select("id", out.alias("resolved"))


@register(f"""WITH {SLOT_OF} SELECT candidate_id, CAST(slot_date AS VARCHAR) AS slot_date, CASE WHEN slot_date = DATE '2001-08-01' THEN 'INTERVIEWED' ELSE 'INTERVIEW_SCHEDULED' END AS stage FROM
  (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY slot_date, slot_time NULLS LAST, id) AS rn FROM slot_of
   WHERE slot_date >= DATE '2001-08-01' AND (slot_time IS NULL OR CAST(slot_date || ' ' || slot_time AS TIMESTAMP) > TIMESTAMP '2001-08-01 11:30:00')) WHERE rn = 1""")
def p7_slot_stage(spark, d):
    booked = p.with_candidate(v.slots(spark, d), v.candidates(spark, d))
    live = booked.filter(p.slot_within_window(F.col("slot_date"), F.col("slot_time"), v.AS_OF))
    return w.next_slot(live, "candidate_id", "2001-08-01").select(
        "candidate_id", F.col("slot_date").cast("string").alias("slot_date"), p.slot_stage(F.col("slot_date"), v.AS_OF).alias("stage")
    )


@register("""SELECT candidate, CASE WHEN min(slot_date) = DATE '2001-08-01' THEN 'INTERVIEWED' ELSE 'INTERVIEW_SCHEDULED' END AS stage FROM slots WHERE slot_date >= DATE '2001-08-01' GROUP BY candidate""")
def p6_slot_stage_by_day(spark, d):
    nxt = w.next_slot(v.slots(spark, d), "candidate", "2001-08-01")
    return nxt.select("candidate", p.slot_stage(F.col("slot_date"), v.AS_OF).alias("stage"))


@register(f"""
WITH prec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(scheduled_at, created_at) DESC, created_at DESC,
  CASE s WHEN 'rescheduled' THEN 0 WHEN 'scheduled' THEN 1 WHEN 'ongoing' THEN 2 WHEN 'completed' THEN 3 WHEN 'no_show' THEN 3 WHEN 'selected' THEN 4 WHEN 'rejected' THEN 4 ELSE 1 END DESC, id) AS rn
  FROM (SELECT *, {CANON} AS s FROM interviews)) WHERE rn = 1)
SELECT * FROM (SELECT candidate_id, {TIMING.format(s='s', at='scheduled_at', now=LOCAL_NOW)} AS bucket FROM prec) WHERE bucket IS NOT NULL""")
def p9_ids_by_timing(spark, d):
    best = w.by_precedence(v.interviews(spark, d), p.canonical_status(F.col("status")))
    return best.select("candidate_id", p.timing_bucket(F.col("status"), F.col("scheduled_at"), v.AS_OF).alias("bucket")).filter("bucket is not null")


@register(f"""
SELECT s AS status, count(*) AS n FROM (SELECT s, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(scheduled_at, created_at) DESC, created_at DESC,
  CASE s WHEN 'rescheduled' THEN 0 WHEN 'scheduled' THEN 1 WHEN 'ongoing' THEN 2 WHEN 'completed' THEN 3 WHEN 'no_show' THEN 3 WHEN 'selected' THEN 4 WHEN 'rejected' THEN 4 ELSE 1 END DESC, id) AS rn
  FROM (SELECT *, {CANON} AS s FROM interviews)) WHERE rn = 1 GROUP BY s""")
def p10_ids_by_status(spark, d):
    best = w.by_precedence(v.interviews(spark, d), p.canonical_status(F.col("status")))
    return best.groupBy(p.canonical_status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""
WITH {SLOT_OF}, a AS (SELECT DISTINCT candidate_id FROM slot_of WHERE slot_date >= DATE '2001-08-01'),
m AS (SELECT candidate_id, max(CASE WHEN email_type = 'interview_invite' THEN 1 ELSE 0 END) AS x FROM messages GROUP BY candidate_id),
i AS (SELECT DISTINCT candidate_id FROM interviews WHERE scheduled_at >= TIMESTAMP '2001-08-01')
SELECT candidate_id, 'slot' AS via FROM a
UNION ALL SELECT candidate_id, 'message' FROM m WHERE x = 1 AND candidate_id NOT IN (SELECT candidate_id FROM a)
UNION ALL SELECT candidate_id, 'interview' FROM i WHERE candidate_id NOT IN (SELECT candidate_id FROM a) AND candidate_id NOT IN (SELECT candidate_id FROM m WHERE x = 1)""")
def p8_fallback_cascade(spark, d):
    return fallback(
        [
            ("slot", p.with_candidate(v.slots(spark, d), v.candidates(spark, d)).filter("slot_date >= date'2001-08-01'")),
            ("message", v.messages(spark, d).filter("email_type = 'interview_invite'")),
            ("interview", v.interviews(spark, d).filter("scheduled_at >= timestamp'2001-08-01'")),
        ]
    )


def fallback(sources):
    """(candidate_id, via): each candidate by the first source that has it; one shuffle for all sources."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.select("candidate_id", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("via")).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("candidate_id").agg(F.min("s").alias("s")).select("candidate_id", "s.via")


@register(f"""
WITH {LATEST}, {BOTH} SELECT id, CASE WHEN stage = 'INTERVIEW_SCHEDULED' AND scheduled_at + INTERVAL 30 MINUTE < TIMESTAMP '2001-08-01 06:30:00' AND ({CANON}) IN ('scheduled', 'rescheduled') THEN 'NO_SHOW' ELSE stage END AS stage FROM both_""")
def p14_no_show(spark, d):
    b = both(spark, d)
    late = F.col("scheduled_at") + F.expr("interval 30 minutes") < F.lit(v.AS_OF).cast("timestamp")
    waiting = p.canonical_status(F.col("status")).isin("scheduled", "rescheduled")
    return b.select("id", F.when((F.col("stage") == "INTERVIEW_SCHEDULED") & late & waiting, "NO_SHOW").otherwise(F.col("stage")).alias("stage"))


@register("""SELECT c.id, CASE WHEN m.candidate_id IS NOT NULL THEN stage WHEN resume_score >= 60 THEN 'SHORTLISTED' WHEN resume_score > 50 THEN 'REVIEW' WHEN resume_score IS NOT NULL THEN 'RESUME_REJECTED' ELSE stage END AS stage
FROM candidates c LEFT JOIN (SELECT DISTINCT candidate_id FROM messages WHERE status = 'sent') m ON m.candidate_id = c.id""")
def p16_score_events(spark, d):
    c = v.candidates(spark, d)
    mailed = v.messages(spark, d).filter("status = 'sent'").select(F.col("candidate_id").alias("_m")).distinct()
    s = F.col("resume_score")
    band = F.when(s >= 60, "SHORTLISTED").when(s > 50, "REVIEW").when(s.isNotNull(), "RESUME_REJECTED").otherwise(F.col("stage"))
    return c.join(mailed, c["id"] == mailed["_m"], "left").select("id", F.when(F.col("_m").isNotNull(), F.col("stage")).otherwise(band).alias("stage"))


@register("""SELECT id, CASE WHEN status <> 'sent' THEN NULL WHEN email_type = 'shortlist_mail' THEN 'SHORTLISTED' WHEN email_type = 'rejection_mail' THEN 'REJECTED' WHEN email_type = 'interview_invite' THEN 'INTERVIEW_SCHEDULED' END AS stage FROM messages""")
def p17_mail_events(spark, d):
    from ..operators.pipeline import literal_map

    to = literal_map({"shortlist_mail": "SHORTLISTED", "rejection_mail": "REJECTED", "interview_invite": "INTERVIEW_SCHEDULED"})
    return v.messages(spark, d).select("id", F.when(F.col("status") == "sent", to[F.col("email_type")]).alias("stage"))


@register(f"""WITH {LATEST}, {BOTH}, r AS (SELECT {REPORTING} AS stage, id FROM both_), s(stage) AS (VALUES ('APPLIED'), ('SHORTLISTED'), ('RESUME_REJECTED'), ('REVIEW'), ('INTERVIEW_SCHEDULED'), ('INTERVIEW_RESCHEDULED'), ('INTERVIEWED'), ('INTERVIEW_FAILED'), ('INTERVIEW_REVIEW'), ('NO_SHOW'), ('SELECTED'), ('REJECTED'))
SELECT s.stage, count(r.id) AS n, min(r.id) AS first_id FROM s LEFT JOIN r ON r.stage = s.stage GROUP BY s.stage""")
def a31_kanban(spark, d):
    from ..schema import STAGES

    shown = both(spark, d).select("id", _reporting().alias("stage"))
    counts = shown.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    dense = w.dense(STAGES, counts.select("stage", "n"), "stage", "n")
    return dense.join(counts.select("stage", "first_id"), "stage", "left").select("stage", "n", "first_id")


@register(f"""WITH {LATEST}, {BOTH} SELECT {DISPLAY} AS stage, count(*) AS n FROM both_ GROUP BY 1""")
def a30_display_counts(spark, d):
    return both(spark, d).groupBy(_display().alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT id, CAST(CAST(scheduled_at + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS day, scheduled_at + INTERVAL 330 MINUTE AS at FROM interviews")
def d1_local_time(spark, d):
    at = p.local_time(F.col("scheduled_at"))
    return v.interviews(spark, d).select("id", F.to_date(at).cast("string").alias("day"), at.alias("at"))


@register("""SELECT id, CASE WHEN trim(coalesce(async_link, '')) LIKE 'https://sessions.example/%' AND trim(coalesce(meeting_link, '')) = '' AND NOT is_async THEN scheduled_at - INTERVAL 330 MINUTE ELSE scheduled_at END AS at FROM interviews""")
def d2_effective_schedule(spark, d):
    at = p.effective_schedule(*[F.col(c) for c in ("scheduled_at", "async_link", "meeting_link", "is_async")], prefix="https://sessions.example/")
    return v.interviews(spark, d).select("id", at.alias("at"))


@register("SELECT TIMESTAMP '2001-08-01 11:30:00' AS cutoff")
def d3_no_show_cutoff(spark, d):
    cut = F.date_trunc("minute", p.local_now(v.AS_OF) - F.expr("interval 30 minutes"))
    return spark.range(1).select(cut.alias("cutoff"))


@register("""SELECT id, slot_time IS NULL OR CAST(slot_date || ' ' || slot_time AS TIMESTAMP) > TIMESTAMP '2001-08-01 11:30:00' AS live FROM slots""")
def d4_slot_window(spark, d):
    return v.slots(spark, d).select("id", p.slot_within_window(F.col("slot_date"), F.col("slot_time"), v.AS_OF).alias("live"))


@register(f"SELECT id, {TIMING.format(s='(' + CANON + ')', at='scheduled_at', now=LOCAL_NOW)} AS bucket FROM interviews")
def d5_timing_bucket(spark, d):
    return v.interviews(spark, d).select("id", p.timing_bucket(F.col("status"), F.col("scheduled_at"), v.AS_OF).alias("bucket"))


@register("SELECT id, scheduled_at - INTERVAL 330 MINUTE AS stored FROM interviews")
def d25_storage_time(spark, d):
    return v.interviews(spark, d).select("id", F.to_utc_timestamp("scheduled_at", "+05:30").alias("stored"))


@register("""SELECT id, CASE WHEN slot_date = DATE '2001-08-01' THEN 'INTERVIEWED' WHEN slot_date > DATE '2001-08-01' THEN 'INTERVIEW_SCHEDULED' END AS stage FROM slots""")
def d26_slot_to_stage(spark, d):
    return v.slots(spark, d).select("id", p.slot_stage(F.col("slot_date"), v.AS_OF).alias("stage"))


@register(f"SELECT id, {CANON} AS status FROM interviews")
def t65_canonical_status(spark, d):
    return v.interviews(spark, d).select("id", p.canonical_status(F.col("status")).alias("status"))


@register("""SELECT id, CASE WHEN stage = 'NO_SHOW' THEN stage WHEN resume_score IS NULL THEN CASE WHEN job_id IS NOT NULL THEN 'REVIEW' ELSE 'APPLIED' END
  WHEN resume_score >= coalesce(score_threshold, 60) THEN 'SHORTLISTED' WHEN resume_score > coalesce(score_threshold, 60) - 10 THEN 'REVIEW' ELSE 'RESUME_REJECTED' END AS stage FROM candidates""")
def m15_stage_from_score(spark, d):
    band = p.stage_from_score(F.col("stage"), F.lit(None).cast("double"), F.col("resume_score"), F.col("score_threshold"), F.col("job_id").isNotNull())
    return v.candidates(spark, d).select("id", band.alias("stage"))


@register(f"WITH {SLOT_OF} SELECT id, candidate_id FROM slot_of")
def j7_polymorphic_key(spark, d):
    return p.with_candidate(v.slots(spark, d), v.candidates(spark, d)).select("id", "candidate_id")


@register(f"WITH {SLOT_OF} SELECT count(*) AS upcoming FROM slot_of WHERE slot_date >= DATE '2001-08-01'")
def a29_upcoming_slots(spark, d):
    booked = p.with_candidate(v.slots(spark, d), v.candidates(spark, d)).filter("slot_date >= date'2001-08-01'")
    return booked.agg(F.count(F.lit(1)).alias("upcoming"))
