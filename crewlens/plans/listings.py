"""Queries of joins, list pages, feeds, lists and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as a
from ..operators import joins as j
from ..operators import pipeline as p
from ..operators import scope
from ..operators import windows as w
from ..sources import feeds
from ..sources import views as v
from .sql_views import Register
from .stages import CANON, LATEST, LOCAL_NOW, SLOT_OF, TIMING, both

register = Register()
ACTIVE = "is_active AND (status IS NULL OR lower(status) IN ('active', 'published', 'open')) AND (valid_through IS NULL OR valid_through >= TIMESTAMP '2001-08-01 06:30:00')"


@register("SELECT c.id, j.title, u.name AS assignee, x.name AS creator FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id LEFT JOIN users u ON u.id = c.assigned_to LEFT JOIN users x ON x.id = c.created_by")
def j1_job_and_users(spark, d):
    u = v.users(spark, d).select("id", "name")
    return (
        v.candidates(spark, d).alias("c").join(v.jobs(spark, d).alias("j"), F.col("c.job_id") == F.col("j.id"), "left")
        .join(u.alias("u"), F.col("c.assigned_to") == F.col("u.id"), "left").join(u.alias("x"), F.col("c.created_by") == F.col("x.id"), "left")
        .select("c.id", "j.title", F.col("u.name").alias("assignee"), F.col("x.name").alias("creator"))
    )


@register(f"SELECT id FROM jobs j WHERE {ACTIVE} AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.job_id = j.id AND c.created_at >= TIMESTAMP '2001-07-02 06:30:00')")
def j4_jobs_without_recent_candidates(spark, d):
    recent = v.candidates(spark, d).filter("created_at >= timestamp'2001-07-02 06:30:00'").select(F.col("job_id").alias("id"))
    return v.jobs(spark, d).filter(scope.active_job(v.AS_OF)).join(recent, "id", "left_anti").select("id")


SESSIONS = """sessions AS (SELECT event_id AS session, CAST(event_id % 3000 AS VARCHAR) AS k1, CASE WHEN event_id % 3 = 0 THEN ' C' || (event_id % 2900) || ' ' END AS k2, CASE WHEN event_id % 5 = 0 THEN upper('c' || (event_id % 2800)) END AS k3,
  CASE WHEN event_id % 4 = 0 THEN 'rec' || event_id END AS recording, ts FROM events)"""
MATCHED = "m AS (SELECT DISTINCT c.id AS candidate_id, s.session, s.recording FROM candidates c JOIN (SELECT session, recording, unnest([k1, k2, k3]) AS k FROM sessions) s ON lower(trim(s.k)) IN (CAST(c.id AS VARCHAR), lower(c.code)))"


def _sessions(spark, d):
    return v.table(spark, d, "events").selectExpr(
        "event_id as session", "cast(event_id % 3000 as string) as k1", "if(event_id % 3 = 0, concat(' C', event_id % 2900, ' '), null) as k2",
        "if(event_id % 5 = 0, upper(concat('c', event_id % 2800)), null) as k3", "if(event_id % 4 = 0, concat('rec', event_id), null) as recording", "ts",
    )


def _matched(spark, d):
    c = v.candidates(spark, d).select(F.col("id").alias("candidate_id"), "code")
    return j.any_key(c, "candidate_id", [F.col("candidate_id"), F.col("code")], _sessions(spark, d), "session", [F.col("k1"), F.col("k2"), F.col("k3")])


@register(f"WITH {SESSIONS}, {MATCHED} SELECT candidate_id, session FROM m")
def j8_any_key(spark, d):
    return _matched(spark, d)


@register(f"WITH {SESSIONS}, {MATCHED} SELECT candidate_id, min(recording) AS recording, count(recording) > 0 AS has_recording FROM m GROUP BY candidate_id")
def q6_recordings(spark, d):
    found = _matched(spark, d).join(_sessions(spark, d).select("session", "recording"), "session")
    return found.groupBy("candidate_id").agg(F.min("recording").alias("recording"), (F.count("recording") > 0).alias("has_recording"))


@register(f"WITH {SESSIONS}, {MATCHED} SELECT candidate_id, session FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY recording IS NULL, session) AS rn FROM m) WHERE rn = 1")
def q7_session_of_candidate(spark, d):
    found = _matched(spark, d).join(_sessions(spark, d).select("session", "recording"), "session")
    return w.first_per_key(found, ["candidate_id"], [F.col("recording").isNull(), F.col("session")]).select("candidate_id", "session")


@register("""WITH r AS (SELECT id, CASE WHEN id % 10 = 3 THEN CAST(id + 1 AS VARCHAR) ELSE code END AS code FROM candidates), l AS (SELECT r.id, x.id AS other FROM r JOIN r x ON lower(trim(r.code)) = CAST(x.id AS VARCHAR))
SELECT id, id AS other FROM r UNION SELECT id, other FROM l UNION SELECT other, id FROM l""")
def j9_related(spark, d):
    code = F.when(F.col("id") % 10 == 3, (F.col("id") + 1).cast("string")).otherwise(F.col("code"))
    return j.related(v.candidates(spark, d), "id", code)


@register("SELECT s.id, m.status, m.sent_at FROM slots s JOIN messages m ON m.id = CAST(regexp_extract(s.id, '^(\\d+)', 1) AS BIGINT)")
def j10_slot_messages(spark, d):
    s = v.slots(spark, d).select("id", F.regexp_extract("id", r"^(\d+)", 1).cast("long").alias("message_id"))
    return s.join(v.messages(spark, d).select(F.col("id").alias("message_id"), "status", "sent_at"), "message_id").select("id", "status", "sent_at")


@register("SELECT c.id FROM candidates c WHERE EXISTS (SELECT 1 FROM messages m WHERE m.candidate_id = c.id AND m.email_type = 'interview_invite' AND m.status = 'sent')")
def j11_invited(spark, d):
    sent = v.messages(spark, d).filter("email_type = 'interview_invite' and status = 'sent'").select(F.col("candidate_id").alias("id"))
    return v.candidates(spark, d).join(sent, "id", "left_semi").select("id")


@register("SELECT c.id, u.name AS owner FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id LEFT JOIN users u ON u.id = coalesce(CASE WHEN c.assigned_to % 3 = 0 THEN NULL ELSE c.assigned_to END, CASE WHEN c.created_by % 2 = 0 THEN NULL ELSE c.created_by END, j.agency_id)")
def j12_coalesced_key(spark, d):
    c = v.candidates(spark, d).join(v.jobs(spark, d).select(F.col("id").alias("job_id"), F.col("agency_id").alias("job_agency")), "job_id", "left")
    key = F.coalesce(F.when(F.col("assigned_to") % 3 != 0, F.col("assigned_to")), F.when(F.col("created_by") % 2 != 0, F.col("created_by")), F.col("job_agency"))
    users = v.users(spark, d).select(F.col("id").alias("_owner"), F.col("name").alias("owner"))
    return c.withColumn("_owner", key.cast("long")).join(users, "_owner", "left").select("id", "owner")


@register("SELECT l.id, l.amount, u.name AS user_name, coalesce(a.name, 'Unknown Agency') AS agency FROM ledger l JOIN users u ON u.id = l.user_id LEFT JOIN agencies a ON a.id = u.agency_id AND a.is_active WHERE l.transaction_type = 'CREDIT' AND u.role = 'admin'")
def q17_credit_history(spark, d):
    u = v.users(spark, d).filter("role = 'admin'").select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), "agency_id")
    names = v.agencies(spark, d).filter("is_active").select(F.col("id").alias("agency_id"), "name")
    credits = v.ledger(spark, d).filter("transaction_type = 'CREDIT'").join(u, "user_id").join(names, "agency_id", "left")
    return credits.select("id", "amount", "user_name", F.coalesce("name", F.lit("Unknown Agency")).alias("agency"))


PORTALS = ("indeed", "jooble", "adzuna")


@register(f"SELECT j.id, p.portal FROM jobs j, (SELECT unnest({list(PORTALS)}) AS portal) p WHERE {ACTIVE}")
def j16_distribution(spark, d):
    """Each active job beside each enabled portal, of which there are a few."""
    return v.jobs(spark, d).filter(scope.active_job(v.AS_OF)).select("id", F.explode(F.array(*[F.lit(x) for x in PORTALS])).alias("portal"))


@register("""SELECT i.id, s.id AS slot FROM (SELECT id, candidate_id, created_at FROM interviews) i LEFT JOIN (SELECT i2.id AS iid, arg_min(s.id, (s.slot_date, s.id)) AS id FROM interviews i2
  JOIN slots s ON s.candidate = CAST(i2.candidate_id AS VARCHAR) AND s.slot_date >= CAST(i2.created_at AS DATE) GROUP BY i2.id) s ON s.iid = i.id""")
def j19_next_slot_after(spark, d):
    """For each interview the candidate's first slot on or after its creation: an as-of join by one sort of both sides."""
    from pyspark.sql import Window

    i = v.interviews(spark, d).select("id", F.col("candidate_id").cast("string").alias("k"), F.to_date("created_at").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("slot"))
    s = v.slots(spark, d).select(F.lit(None).cast("string").alias("id"), F.col("candidate").alias("k"), F.col("slot_date").alias("day"), F.lit(2).alias("kind"), F.col("id").alias("slot"))
    ahead = Window.partitionBy("k").orderBy("day", "kind", "slot").rowsBetween(0, Window.unboundedFollowing)
    return i.unionByName(s).withColumn("slot", F.first("slot", ignorenulls=True).over(ahead)).filter("kind = 1").select("id", "slot")


@register("SELECT id FROM candidates WHERE stage = 'SELECTED' UNION SELECT candidate_id FROM interviews WHERE status = 'completed'")
def u1_union(spark, d):
    one = v.candidates(spark, d).filter("stage = 'SELECTED'").select("id")
    return one.union(v.interviews(spark, d).filter("status = 'completed'").select("candidate_id")).distinct()


@register("""WITH x AS (SELECT id, list_distinct(list_transform(skills, lambda s: lower(trim(s)))) AS a, ['python', 'react.js', 'go', 'rust'] AS b FROM candidates WHERE skills IS NOT NULL), y AS (SELECT *, len(list_intersect(a, b)) AS h FROM x)
SELECT id, CAST(h AS INT) AS hits, CAST(4 - h AS INT) AS missing, CAST(len(a) - h AS INT) AS unexpected, round(h * 1.0 / len(a), 4) AS precision, round(h / 4.0, 4) AS recall FROM y""")
def u2_skill_overlap(spark, d):
    wanted = F.array(*[F.lit(x) for x in ("Python", "React.JS", "go", "rust")])
    return v.candidates(spark, d).filter("skills is not null").select("id", a.overlap(F.col("skills"), wanted).alias("o")).select("id", "o.*")


@register("""WITH a AS (SELECT CAST(regexp_extract(candidate, '(\\d+)', 1) AS BIGINT) AS k, 'slot' AS source FROM slots GROUP BY 1), b AS (SELECT DISTINCT candidate_id AS k, 'interview' AS source FROM interviews), c AS (SELECT id AS k, 'candidate' AS source FROM candidates)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b)""")
def u3_first_source(spark, d):
    one = v.slots(spark, d).select(F.regexp_extract("candidate", r"(\d+)", 1).cast("long").alias("k")).distinct().withColumn("source", F.lit("slot"))
    two = v.interviews(spark, d).select(F.col("candidate_id").alias("k")).distinct().withColumn("source", F.lit("interview"))
    return j.first_source("k", one, two, v.candidates(spark, d).select(F.col("id").alias("k"), F.lit("candidate").alias("source")))


@register("SELECT id, CASE id % 3 WHEN 0 THEN 'SQL,Python' WHEN 1 THEN 'Go' ELSE '' END AS kept FROM jobs")
def c1_distinct_ignoring_case(spark, d):
    lists = F.when(F.col("id") % 3 == 0, F.array(*[F.lit(x) for x in ("SQL", " sql ", "Python", "PYTHON")])).when(F.col("id") % 3 == 1, F.array(F.lit("Go"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    return v.jobs(spark, d).select("id", F.array_join(a.distinct_ignoring_case(lists), ",").alias("kept"))


@register("SELECT id, CASE id % 2 WHEN 0 THEN 1 ELSE 2 END AS kept FROM jobs")
def c2_distinct_by_identity(spark, d):
    entry = lambda r, c, n: F.struct(F.lit(r).alias("role"), F.lit(c).alias("company"), n.alias("n"))
    lists = F.array(entry("Dev", "X", F.col("id")), entry(" dev", "x", F.col("id") + 1), entry("", " ", F.col("id")), F.struct(F.when(F.col("id") % 2 == 1, "QA").otherwise("DEV").alias("role"), F.lit("X").alias("company"), F.col("id").alias("n")))
    return v.jobs(spark, d).select("id", F.size(a.distinct_by(lists, ["role", "company"])).alias("kept"))


@register("""SELECT candidate_id, arg_max(id, (status = 'in progress', coalesce(scheduled_at, created_at), created_at, id)) AS id FROM interviews GROUP BY candidate_id""")
def c5_current_entry(spark, d):
    entry = F.struct((F.col("status") == "in progress").alias("is_current"), F.coalesce("scheduled_at", "created_at").alias("end"), F.col("created_at").alias("start"), F.col("id").alias("id"))
    ranked = F.struct(*[entry[x].alias(x) for x in ("is_current", "end", "start", "id")])
    return v.interviews(spark, d).groupBy("candidate_id").agg(F.max(ranked)["id"].alias("id"))


@register("""SELECT id, CASE id % 2 WHEN 0 THEN array_to_string(from_json(skills_json, '["VARCHAR"]'), ',') ELSE 'a,b' END AS skills FROM jobs""")
def c7_skill_list(spark, d):
    said = F.when(F.col("id") % 2 == 0, F.col("skills_json")).otherwise("a, b ,A,")
    return v.jobs(spark, d).select("id", F.array_join(a.skill_list(said), ",").alias("skills"))


@register("SELECT id, name, email, score FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY filled DESC, score DESC NULLS LAST, id) AS rn FROM (SELECT id, name, email, resume_score AS score, (job_id IS NOT NULL)::INT + (skills IS NOT NULL)::INT + (source IS NOT NULL)::INT AS filled FROM candidates)) WHERE rn = 1")
def c11_most_complete(spark, d):
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("job_id", "skills", "source")), F.lit(0))
    c = v.candidates(spark, d).select("id", "name", "email", F.col("resume_score").alias("score"), filled.alias("filled"))
    return w.first_per_key(c, ["email"], [F.col("filled").desc(), F.col("score").desc_nulls_last(), F.col("id")]).drop("filled")


@register("SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY job_id, lower(email), lower(name) ORDER BY id) AS rn FROM candidates WHERE job_id IS NOT NULL) WHERE rn = 1 UNION ALL SELECT id, name FROM candidates WHERE job_id IS NULL")
def c12_schedulable(spark, d):
    c = v.candidates(spark, d)
    key = F.when(F.col("job_id").isNull(), F.concat(F.lit("id:"), F.col("id"))).otherwise(F.concat_ws("\x1f", F.col("job_id"), F.lower("email"), F.lower("name")))
    return w.first_per_key(c.withColumn("_key", key), ["_key"], [F.col("id")]).select("id", "name")


@register("SELECT id, '<job><id>' || id || '</id><title>' || title || '</title><company>' || coalesce(company_name, '') || '</company><salary>' || salary_range || '</salary></job>' AS node FROM jobs")
def k6_feed(spark, d):
    f = {"id": F.col("id"), "title": F.col("title"), "company": F.col("company_name"), "salary": F.col("salary_range")}
    return feeds.job_nodes(v.jobs(spark, d), f)


@register("SELECT id, '<url><loc>https://jobs.example/?a=1&amp;id=' || id || '</loc><lastmod>' || strftime(created_at, '%Y-%m-%d') || '</lastmod></url>' AS node FROM jobs")
def k8_site_map(spark, d):
    jobs = v.jobs(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return feeds.site_map(jobs, F.concat(F.lit("https://jobs.example/?a=1&id="), F.col("id")))


@register("""SELECT id, 'Engineer ' || (id % 50) AS title, trim(company_name) AS company, CAST(10000 + id AS DOUBLE) AS low, CAST(20000 + 2 * id AS DOUBLE) AS high, valid_through IS NULL AS endless FROM jobs""")
def k9_job_posting(spark, d):
    x = feeds.job_posting(v.jobs(spark, d))
    get = lambda path: F.get_json_object("posting", path)
    return x.select("id", get("$.title").alias("title"), get("$.hiringOrganization.name").alias("company"), get("$.baseSalary.value.minValue").cast("double").alias("low"), get("$.baseSalary.value.maxValue").cast("double").alias("high"), get("$.validThrough").isNull().alias("endless"))


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, left(coalesce(text, ''), 2000) AS text, source FROM documents")
def k10_sheet(spark, d):
    return feeds.sheet(v.table(spark, d, "documents").select("doc_id", "text", "source"), {"text": 2000})


@register("SELECT c.id, c.name, j.title FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id WHERE c.id = 77")
def q1_candidate(spark, d):
    jobs = v.jobs(spark, d).select(F.col("id").alias("job_id"), "title")
    return v.candidates(spark, d).filter("id = 77").join(jobs, "job_id", "left").select("id", "name", "title")


@register("SELECT c.id, j.title, coalesce(c.stage, 'REVIEW') AS review FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id WHERE c.assigned_to = 7")
def q2_my_assignments(spark, d):
    jobs = v.jobs(spark, d).select(F.col("id").alias("job_id"), "title")
    return v.candidates(spark, d).filter("assigned_to = 7").join(jobs, "job_id", "left").select("id", "title", F.coalesce("stage", F.lit("REVIEW")).alias("review"))


@register("""SELECT id, n FROM (SELECT id FROM jobs ORDER BY created_at DESC, id LIMIT 200 OFFSET 200) p JOIN (SELECT job_id, count(*) AS n FROM candidates WHERE assigned_to < 50 GROUP BY job_id) c ON c.job_id = p.id""")
def q8_jobs_page(spark, d):
    """The page is cut first; then jobs without candidates of one's own are left out, so a page may be short."""
    jobs = scope.page(v.jobs(spark, d), [F.col("created_at").desc(), F.col("id")], page=2, limit=200).select("id")
    counts = v.candidates(spark, d).filter("assigned_to < 50").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return jobs.join(counts, "id")


@register("SELECT m.id, c.name, coalesce(list_aggregate(list_transform(string_split(m.email_type, '_'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' '), '') AS kind, upper(m.status[1]) || m.status[2:] AS status, strftime(coalesce(m.sent_at, m.created_at), '%Y-%m-%d') AS day FROM messages m JOIN candidates c ON c.id = m.candidate_id WHERE c.assigned_to = 7")
def q11_message_list(spark, d):
    mine = v.candidates(spark, d).filter("assigned_to = 7").select(F.col("id").alias("candidate_id"), "name")
    kind = F.coalesce(F.initcap(F.replace(F.col("email_type"), F.lit("_"), F.lit(" "))), F.lit(""))
    return v.messages(spark, d).join(mine, "candidate_id").select("id", "name", kind.alias("kind"), F.initcap("status").alias("status"), F.date_format(F.coalesce("sent_at", "created_at"), "yyyy-MM-dd").alias("day"))


@register("SELECT u.id, u.name, a.name AS agency, coalesce(u.last_login_at > TIMESTAMP '2001-08-01 06:15:00', false) AS online FROM users u LEFT JOIN agencies a ON a.id = u.agency_id WHERE u.agency_id = 2")
def q13_users(spark, d):
    names = v.agencies(spark, d).select(F.col("id").alias("agency_id"), F.col("name").alias("agency"))
    online = F.coalesce(F.col("last_login_at") > F.lit("2001-08-01 06:15:00").cast("timestamp"), F.lit(False))
    return v.users(spark, d).filter("agency_id = 2").join(F.broadcast(names), "agency_id", "left").select("id", "name", "agency", online.alias("online"))  # five rows


@register("SELECT id, CASE WHEN scheduled_at < TIMESTAMP '1995-01-01' THEN 'expired' WHEN status = 'scheduled' AND async_completed_at IS NULL THEN 'in_progress' ELSE status END AS state FROM interviews WHERE is_async")
def q21_async_state(spark, d):
    state = F.when(F.col("scheduled_at") < F.lit("1995-01-01").cast("timestamp"), "expired").when((F.col("status") == "scheduled") & F.col("async_completed_at").isNull(), "in_progress").otherwise(F.col("status"))
    return v.interviews(spark, d).filter("is_async").select("id", state.alias("state"))


@register("SELECT u.id AS user_id, w.widget, CAST(coalesce(p.position, w.widget) AS INT) AS position FROM users u, (SELECT unnest([0, 1, 2]) AS widget) w LEFT JOIN (SELECT s_suppkey AS uid, unnest([0, 1, 2]) AS pw, 2 - unnest([0, 1, 2]) AS position FROM supplier WHERE s_suppkey % 2 = 0) p ON p.uid = u.id AND p.pw = w.widget")
def q22_widgets(spark, d):
    """A user's own order of widgets, else the default order."""
    widgets = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("widget")
    own = v.users(spark, d).filter("id % 2 = 0").select(F.col("id").alias("user_id"), widgets).withColumn("own", 2 - F.col("widget"))
    every = v.users(spark, d).select(F.col("id").alias("user_id"), widgets)
    return every.join(own, ["user_id", "widget"], "left").select("user_id", "widget", F.coalesce("own", "widget").alias("position"))


LIVE = "status NOT IN ('selected', 'rejected', 'completed')"


@register(f"SELECT candidate_id, id FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scheduled_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id DESC) AS rn FROM interviews WHERE {LIVE}) WHERE rn = 1")
def q23_reschedulable(spark, d):
    return w.latest_interview(v.interviews(spark, d).filter(LIVE)).select("candidate_id", "id")


@register(f"SELECT id, candidate_id, CASE WHEN {LIVE} AND rn > 1 THEN 'rescheduled' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, {LIVE} ORDER BY scheduled_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id DESC) AS rn FROM interviews)")
def q24_others_rescheduled(spark, d):
    i = v.interviews(spark, d).withColumn("live", F.expr(LIVE))
    order = [F.col("scheduled_at").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.col("id").desc()]
    n = j.numbered(i, ["candidate_id", "live"], order)
    return n.select("id", "candidate_id", F.when(F.col("live") & (F.col("n") > 1), "rescheduled").otherwise(F.col("status")).alias("status"))


@register("""WITH t AS (SELECT * FROM interviews WHERE status = 'scheduled' AND CAST(scheduled_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-08' ORDER BY scheduled_at, id LIMIT 10)
SELECT candidate_id, id FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scheduled_at DESC, created_at DESC, id DESC) AS rn FROM t) WHERE rn = 1""")
def l4_upcoming(spark, d):
    """The ten that come next, and of them the latest of each candidate."""
    week = v.interviews(spark, d).filter("status = 'scheduled' and to_date(scheduled_at) between date'1995-01-01' and date'1995-01-08'")
    return w.latest_interview(week.orderBy("scheduled_at", "id").limit(10)).select("candidate_id", "id")


@register(f"""WITH {LATEST}, s AS (SELECT candidate_id, scheduled_at, {CANON} AS s FROM latest), t AS (SELECT *, {TIMING.format(s="'scheduled'", at='scheduled_at', now=LOCAL_NOW)} AS t FROM s)
SELECT candidate_id, CASE s WHEN 'completed' THEN 'INTERVIEWED' WHEN 'ongoing' THEN 'INTERVIEWED' WHEN 'no_show' THEN 'NO_SHOW' WHEN 'scheduled' THEN CASE WHEN t = 'today' THEN 'INTERVIEWED' ELSE 'INTERVIEW_SCHEDULED' END
  WHEN 'rescheduled' THEN CASE WHEN t = 'today' THEN 'INTERVIEWED' ELSE 'INTERVIEW_RESCHEDULED' END END AS stage FROM t""")
def p15_stage_of_interview(spark, d):
    s = p.canonical_status(F.col("status"))
    today = F.coalesce(p.timing_bucket(F.lit("scheduled"), F.col("scheduled_at"), v.AS_OF) == "today", F.lit(False))
    out = F.when(s.isin("completed", "ongoing") | (s.isin("scheduled", "rescheduled") & today), "INTERVIEWED").when(s == "no_show", "NO_SHOW").when(s == "scheduled", "INTERVIEW_SCHEDULED").when(s == "rescheduled", "INTERVIEW_RESCHEDULED")
    return w.latest_interview(v.interviews(spark, d)).select("candidate_id", out.alias("stage"))


@register(f"""WITH {LATEST} SELECT CASE WHEN status IN ('scheduled', 'rescheduled') THEN 'upcoming' WHEN status = 'in progress' THEN 'running' WHEN status = 'completed' THEN 'done' ELSE 'other' END AS bucket, count(*) AS n FROM latest GROUP BY 1""")
def p19_dashboard_buckets(spark, d):
    status = F.col("status")
    bucket = F.when(status.isin("scheduled", "rescheduled"), "upcoming").when(status == "in progress", "running").when(status == "completed", "done").otherwise("other")
    return w.latest_interview(v.interviews(spark, d)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("""WITH x AS (SELECT c.id, c.stage, max(s.slot_date) AS booked FROM candidates c LEFT JOIN slots s ON regexp_extract(s.candidate, '(\\d+)', 1) = CAST(c.id AS VARCHAR) AND s.created_at >= c.stage_entered_at GROUP BY ALL)
SELECT id, CASE WHEN booked = DATE '2001-08-01' THEN 'INTERVIEWED' WHEN booked > DATE '2001-08-01' THEN 'INTERVIEW_SCHEDULED' ELSE stage END AS stage FROM x""")
def p11_session_stage(spark, d):
    """A slot booked since the stage was entered moves the candidate, unless it is past."""
    s = p.with_candidate(v.slots(spark, d), v.candidates(spark, d)).select("candidate_id", "slot_date", F.col("created_at").alias("booked_at"))
    c = v.candidates(spark, d)
    live = c.join(s, (c["id"] == s["candidate_id"]) & (s["booked_at"] >= c["stage_entered_at"]), "left").groupBy("id", "stage").agg(F.max("slot_date").alias("booked"))
    today = F.lit("2001-08-01").cast("date")
    return live.select("id", F.when(F.col("booked") == today, "INTERVIEWED").when(F.col("booked") > today, "INTERVIEW_SCHEDULED").otherwise(F.col("stage")).alias("stage"))


@register("""WITH e AS (SELECT doc_id, quality, toxic, doc_id % 3 = 0 AS said FROM labels) SELECT count(*) AS cases, round(avg(CASE WHEN (quality = 1) = said THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(abs(quality - toxic)), 4) AS mean_error,
  round(count(*) FILTER (said AND quality = 1) * 1.0 / count(*) FILTER (said), 4) AS precision, round(count(*) FILTER (said AND quality = 1) * 1.0 / count(*) FILTER (quality = 1), 4) AS recall FROM e""")
def a35_benchmark(spark, d):
    said, good = F.col("doc_id") % 3 == 0, F.col("quality") == 1
    rate = lambda x, whole: F.round(F.try_divide(F.count_if(x).cast("double"), F.count_if(whole)), 4)
    return v.table(spark, d, "labels").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg((good == said).cast("int")), 4).alias("accuracy"), F.round(F.avg(F.abs(F.col("quality") - F.col("toxic"))), 4).alias("mean_error"),
        rate(said & good, said).alias("precision"), rate(said & good, good).alias("recall"),
    )


@register("""SELECT action, count(*) AS runs, count(*) FILTER (value > 100) AS slow, count(*) FILTER (value < 20) AS low, round(count(*) FILTER (value > 100) * 100.0 / count(*), 2) AS slow_share FROM activity GROUP BY action""")
def a37_audit(spark, d):
    n = F.count(F.lit(1))
    return v.activity(spark, d).groupBy("action").agg(n.alias("runs"), F.count_if(F.col("value") > 100).alias("slow"), F.count_if(F.col("value") < 20).alias("low"), F.round(F.count_if(F.col("value") > 100) * 100.0 / n, 2).alias("slow_share"))


@register(f"WITH {LATEST} SELECT c.id, c.stage, l.status FROM candidates c LEFT JOIN latest l ON l.candidate_id = c.id")
def p18_listing(spark, d):
    """All candidates with the stored stage and the latest interview's status; the stage that is shown is p18_display_override's."""
    return both(spark, d).select("id", "stage", "status")


@register(f"""WITH {SLOT_OF}, a AS (SELECT candidate_id, min(slot_date) AS slot_date FROM slot_of WHERE slot_date >= CAST({LOCAL_NOW} AS DATE) GROUP BY candidate_id),
prec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(scheduled_at, created_at) DESC, created_at DESC,
  CASE s WHEN 'rescheduled' THEN 0 WHEN 'scheduled' THEN 1 WHEN 'ongoing' THEN 2 WHEN 'completed' THEN 3 WHEN 'no_show' THEN 3 WHEN 'selected' THEN 4 WHEN 'rejected' THEN 4 ELSE 1 END DESC, id) AS rn
  FROM (SELECT *, {CANON} AS s FROM interviews)) WHERE rn = 1), i AS (SELECT candidate_id, {TIMING.format(s='s', at='scheduled_at', now=LOCAL_NOW)} AS bucket FROM prec)
SELECT c.id, CASE WHEN c.stage = 'INTERVIEW_RESCHEDULED' THEN c.stage WHEN a.slot_date = CAST({LOCAL_NOW} AS DATE) THEN 'INTERVIEWED' WHEN a.slot_date IS NOT NULL THEN 'INTERVIEW_SCHEDULED'
  WHEN bucket = 'today' THEN 'INTERVIEWED' WHEN bucket = 'future' THEN 'INTERVIEW_SCHEDULED' ELSE c.stage END AS stage
FROM candidates c LEFT JOIN a ON a.candidate_id = c.id LEFT JOIN i ON i.candidate_id = c.id""")
def p18_display_override(spark, d):
    """All candidates; sessions are rows of ``slots`` in these views, so a coming session is already a coming slot."""
    return displayed(v.candidates(spark, d), v.slots(spark, d), v.interviews(spark, d), v.AS_OF)


def displayed(candidates, slots, interviews, as_of):
    """(id, stage) of all candidates, with the stage that the listing shows."""
    coming = p.with_candidate(slots, candidates).filter(F.col("slot_date") >= F.to_date(p.local_now(as_of)))
    first = coming.groupBy("candidate_id").agg(F.min("slot_date").alias("slot_date"))
    best = w.by_precedence(interviews, p.canonical_status(F.col("status")))
    timed = best.select("candidate_id", p.timing_bucket(F.col("status"), F.col("scheduled_at"), as_of).alias("bucket"))
    rows = candidates.select(F.col("id").alias("candidate_id"), "stage").join(first, "candidate_id", "left").join(timed, "candidate_id", "left")
    return rows.select(F.col("candidate_id").alias("id"), p.listing_stage(F.col("stage"), F.col("slot_date"), F.col("bucket"), as_of).alias("stage"))
