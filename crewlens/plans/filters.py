"""Queries of filters, visibility, searches and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope
from ..operators.scope import Viewer
from ..sources import views as v
from .sql_views import Register

register = Register()
ADMIN = Viewer(id=0, role="admin", agency_id=2)


@register("""SELECT id, stage, created_at FROM candidates WHERE created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1996-04-16'""")
def f1_date_window(spark, d):
    return scope.date_window(v.candidates(spark, d), "created_at", "1996-03-01", "1996-04-15").select("id", "stage", "created_at")


@register("""SELECT id, created_at FROM candidates WHERE year(created_at) = 1997 AND month(created_at) = 2""")
def f1_month_window(spark, d):
    return scope.date_window(v.candidates(spark, d), "created_at", month="1997-02").select("id", "created_at")


@register("""SELECT id, created_at FROM candidates WHERE created_at >= TIMESTAMP '2001-08-01 06:30:00' - INTERVAL 90 DAY""")
def f2_rolling_window(spark, d):
    return scope.rolling_window(v.candidates(spark, d), "created_at", "last_3_months", v.AS_OF).select("id", "created_at")


@register("""
SELECT * FROM (VALUES ('custom', TIMESTAMP '2001-03-01', TIMESTAMP '2001-03-10 23:59:59', TIMESTAMP '2001-02-19 00:00:01', TIMESTAMP '2001-03-01'),
  ('last_7_days', TIMESTAMP '2001-07-25 06:30:00', TIMESTAMP '2001-08-01 06:30:00', TIMESTAMP '2001-07-18 06:30:00', TIMESTAMP '2001-07-25 06:30:00'),
  ('?', TIMESTAMP '2001-07-02 06:30:00', TIMESTAMP '2001-08-01 06:30:00', TIMESTAMP '2001-06-02 06:30:00', TIMESTAMP '2001-07-02 06:30:00')) t(name, a, b, c, d)""")
def f3_period_windows(spark, d):
    rows = [(n, *scope.period_windows(n, v.AS_OF, "2001-03-01", "2001-03-10")) for n in ("custom", "last_7_days", "?")]
    return spark.createDataFrame(rows, "name string, a timestamp, b timestamp, c timestamp, d timestamp")


@register("""
SELECT c.id FROM candidates c WHERE c.assigned_to = 17
  AND EXISTS (SELECT 1 FROM jobs j WHERE j.id = c.job_id AND lower(trim(j.company_name)) = 'nation_3')
  AND EXISTS (SELECT 1 FROM jobs j WHERE j.id = c.job_id AND j.department = 'BUILDING')
UNION ALL SELECT -1 - count(*) FROM candidates""")
def f4_scope_filters(spark, d):
    c, j = v.candidates(spark, d), v.jobs(spark, d)
    some = scope.scoped(c, j, recruiter="17", client=" Nation_3", department="BUILDING").select("id")
    every = scope.scoped(c, j, recruiter="no-id", client="all", department="all")
    return some.union(every.agg((-1 - F.count(F.lit(1))).alias("id")))


@register("""
SELECT c.id FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id LEFT JOIN users a ON a.id = c.created_by LEFT JOIN users b ON b.id = c.assigned_to
WHERE c.agency_id = 2 OR j.agency_id = 2 OR a.agency_id = 2 OR b.agency_id = 2""")
def f5_visibility_admin(spark, d):
    return scope.visible_candidates(v.candidates(spark, d), v.jobs(spark, d), v.users(spark, d), ADMIN).select("id")


@register("""SELECT id FROM candidates WHERE job_id IN (SELECT id FROM jobs WHERE lower(trim(company_name)) = 'nation_7')""")
def f5_visibility_client(spark, d):
    viewer = Viewer(id=0, role="client", company="NATION_7 ")
    return scope.visible_candidates(v.candidates(spark, d), v.jobs(spark, d), v.users(spark, d), viewer).select("id")


@register("""SELECT id FROM candidates WHERE assigned_to = 42""")
def f5_visibility_recruiter(spark, d):
    viewer = Viewer(id=42, role="recruiter")
    return scope.visible_candidates(v.candidates(spark, d), v.jobs(spark, d), v.users(spark, d), viewer).select("id")


@register("""SELECT id, title FROM jobs WHERE id IN (SELECT job_id FROM candidates WHERE assigned_to = 42)""")
def f6_job_visibility(spark, d):
    return scope.visible_jobs(v.jobs(spark, d), v.candidates(spark, d), Viewer(id=42, role="recruiter")).select("id", "title")


@register("""SELECT id FROM candidates WHERE agency_id = 2 OR job_id IN (SELECT id FROM jobs WHERE agency_id = 2)
  OR created_by IN (SELECT id FROM users WHERE agency_id = 2) OR assigned_to IN (SELECT id FROM users WHERE agency_id = 2)""")
def f7_candidate_list_scope(spark, d):
    return scope.visible_candidates(v.candidates(spark, d), v.jobs(spark, d), v.users(spark, d), ADMIN).select("id")


@register("""
SELECT c.id FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id
WHERE c.name ILIKE '%nation_1%' OR c.email ILIKE '%nation_1%' OR CAST(to_json(c.skills) AS VARCHAR) ILIKE '%nation\\_1%' ESCAPE '\\'
   OR j.title ILIKE '%nation\\_1%' ESCAPE '\\' OR j.company_name ILIKE '%nation\\_1%' ESCAPE '\\' OR j.department ILIKE '%nation\\_1%' ESCAPE '\\' OR j.city ILIKE '%nation\\_1%' ESCAPE '\\'""")
def f8_candidate_search(spark, d):
    return scope.search_candidates(v.candidates(spark, d), v.jobs(spark, d), "Nation_1").select("id")


@register("""SELECT id FROM candidates WHERE skills IS NOT NULL AND CAST(to_json(skills) AS VARCHAR) ILIKE '%machine%'""")
def f8_skill_search(spark, d):
    return scope.search_candidates(v.candidates(spark, d), v.jobs(spark, d), "MACHINE l").select("id")


@register("""SELECT id FROM candidates WHERE job_id IN (SELECT id FROM jobs WHERE lower(trim(company_name)) = lower(trim(' Nation_5 ')))""")
def f9_client_filter(spark, d):
    return scope.of_client(v.candidates(spark, d), v.jobs(spark, d), " Nation_5 ").select("id")


@register("""SELECT id FROM candidates WHERE assigned_to = 42 AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'""")
def f10_dashboard_filters(spark, d):
    c = scope.visible_candidates(v.candidates(spark, d), v.jobs(spark, d), v.users(spark, d), Viewer(id=42, role="recruiter"))
    return scope.date_window(c, "created_at", "1996-01-01", "1998-12-31").select("id")


@register("""SELECT id, created_at FROM candidates WHERE CAST(created_at AS DATE) = DATE '1998-05-04'""")
def f11_created_on(spark, d):
    return scope.date_window(v.candidates(spark, d), "created_at", date="1998-05-04").select("id", "created_at")


@register("""SELECT id FROM jobs j WHERE agency_id = 3 OR EXISTS (SELECT 1 FROM candidates c WHERE c.job_id = j.id AND c.agency_id = 3)""")
def f12_job_list_scope(spark, d):
    j, c = v.jobs(spark, d), v.candidates(spark, d)
    via = c.filter("agency_id = 3 and job_id is not null").select(F.col("job_id").alias("_j")).distinct()
    return j.join(via, j["id"] == via["_j"], "left").filter("agency_id = 3 or _j is not null").select("id")


@register("""SELECT id FROM jobs WHERE title ILIKE '%mum%' OR company_name ILIKE '%mum%' OR city ILIKE '%mum%' OR state ILIKE '%mum%' OR skills_json ILIKE '%mum%'""")
def f13_job_search(spark, d):
    return scope.search_jobs(v.jobs(spark, d), "MUM").select("id")


@register("""SELECT id FROM jobs WHERE (city ILIKE '%pune%' OR state ILIKE '%pune%' OR country ILIKE '%pune%') AND skills_json ILIKE '%sql%' AND skills_json ILIKE '%java%' AND lower(status) = 'closed'""")
def f14_job_attributes(spark, d):
    return scope.filter_jobs(v.jobs(spark, d), "Pune", "sql, java ,", "Closed").select("id")


@register("""SELECT i.id FROM interviews i LEFT JOIN candidates c ON c.id = i.candidate_id LEFT JOIN jobs j ON j.id = c.job_id
WHERE i.status ILIKE '%no-show%' OR i.transcript ILIKE '%no-show%' OR c.name ILIKE '%no-show%' OR j.title ILIKE '%no-show%'""")
def f15_interview_search(spark, d):
    return scope.search_interviews(v.interviews(spark, d), v.candidates(spark, d), v.jobs(spark, d), "no-SHOW")


@register("""SELECT i.id FROM interviews i WHERE EXISTS (SELECT 1 FROM candidates c JOIN jobs j ON j.id = c.job_id WHERE c.id = i.candidate_id AND lower(trim(j.company_name)) = 'nation_9')""")
def f16_interview_client(spark, d):
    own = scope.of_client(v.candidates(spark, d), v.jobs(spark, d), "NATION_9").select(F.col("id").alias("candidate_id"))
    return v.interviews(spark, d).join(own, "candidate_id", "left_semi").select("id")


@register("""SELECT id FROM interviews WHERE CAST(coalesce(scheduled_at, created_at) AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-01-31'""")
def f17_interview_date(spark, d):
    return scope.date_window(v.interviews(spark, d), F.coalesce("scheduled_at", "created_at"), "1997-01-01", "1997-01-31").select("id")


@register("""SELECT i.id FROM interviews i JOIN candidates c ON c.id = i.candidate_id LEFT JOIN jobs j ON j.id = c.job_id WHERE c.agency_id = 1 OR j.agency_id = 1""")
def f18_interview_scope(spark, d):
    i = v.interviews(spark, d)
    c = v.candidates(spark, d).select(F.col("id").alias("_c"), "agency_id", "job_id")
    j = v.jobs(spark, d).select(F.col("id").alias("_j"), F.col("agency_id").alias("_a"))
    both = i.join(c, i["candidate_id"] == c["_c"]).join(j, c["job_id"] == j["_j"], "left")
    return both.filter("agency_id = 1 or _a = 1").select(i["id"])


@register("""SELECT stage, count(*) AS n FROM candidates WHERE stage NOT IN ('OFFER_MADE') GROUP BY stage""")
def f19_enum_guard(spark, d):
    from ..schema import STAGES

    return v.candidates(spark, d).filter(F.col("stage").isin(*STAGES)).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT id FROM jobs WHERE is_active AND (status IS NULL OR lower(status) IN ('active', 'published', 'open')) AND (valid_through IS NULL OR valid_through >= TIMESTAMP '2001-08-01 06:30:00')""")
def f20_active_jobs(spark, d):
    return v.jobs(spark, d).filter(scope.active_job(v.AS_OF)).select("id")


@register("""SELECT id FROM jobs WHERE is_active AND lower(trim(coalesce(status, 'open'))) IN ('active', 'published', 'open') AND (valid_through IS NULL OR valid_through >= TIMESTAMP '2001-08-01 06:30:00')""")
def f21_open_jobs(spark, d):
    return v.jobs(spark, d).filter(scope.open_job(v.AS_OF)).select("id")


@register("""
SELECT agency_id, id FROM (SELECT agency_id, id, row_number() OVER (PARTITION BY agency_id ORDER BY ts DESC, id DESC) AS rn FROM usage
  WHERE ts + INTERVAL 20 DAY > TIMESTAMP '2024-01-31' AND feature = 'resume') WHERE rn = 1""")
def f22_active_subscription(spark, d):
    from ..operators.windows import first_per_key

    s = v.usage(spark, d).filter("feature = 'resume'").withColumn("expires_at", F.expr("ts + interval 20 days"))
    live = s.filter(F.col("expires_at") > F.lit(v.EVENTS_AS_OF).cast("timestamp"))
    return first_per_key(live, ["agency_id"], [F.col("ts").desc(), F.col("id").desc()]).select("agency_id", "id")


@register("""SELECT page_id, url FROM pages WHERE regexp_matches(lower(split_part(split_part(url, '#', 1), '?', 1)), '[.](pdf|docx?|html)$') OR regexp_matches(url, '/en/')""")
def f23_type_filter(spark, d):
    pages = v.table(spark, d, "pages")
    path = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return pages.filter(path.rlike(r"(?i)\.(pdf|docx?|html)$") | F.col("url").contains("/en/")).select("page_id", "url")


@register("""SELECT id FROM candidates WHERE coalesce(resume_score, 0) >= 40 AND coalesce(resume_score, 0) <= 60 AND stage IN ('REVIEW', 'SELECTED') AND job_id IS NULL""")
def f24_orphan_bucket(spark, d):
    score = F.coalesce("resume_score", F.lit(0.0))
    c = v.candidates(spark, d)
    return c.filter((score >= 40) & (score <= 60) & F.col("stage").isin("REVIEW", "SELECTED") & F.col("job_id").isNull()).select("id")


@register("""SELECT m.id FROM messages m JOIN candidates c ON c.id = m.candidate_id WHERE (c.name ILIKE '%d 11%' OR c.email ILIKE '%d 11%') AND m.email_type IN ('shortlist_mail', 'offer_letter')""")
def f25_message_filter(spark, d):
    c = v.candidates(spark, d).select(F.col("id").alias("candidate_id"), "name", "email")
    both = v.messages(spark, d).join(c, "candidate_id")
    return both.filter(scope.contains("D 11", F.col("name"), F.col("email")) & F.col("email_type").isin("shortlist_mail", "offer_letter")).select("id")


@register("""SELECT id FROM jobs WHERE (title ILIKE '%build%' OR company_name ILIKE '%build%' OR department ILIKE '%build%' OR city ILIKE '%build%') AND lower(status) = 'open'""")
def f26_distribution_filter(spark, d):
    found = scope.contains("build", *[F.col(c) for c in ("title", "company_name", "department", "city")])
    return v.jobs(spark, d).filter(found & (F.lower("status") == "open")).select("id")


@register("""SELECT a.id FROM candidates a WHERE a.id >= 5000 AND EXISTS (SELECT 1 FROM candidates b WHERE b.id < 5000 AND a.job_id % 50 = b.job_id % 50
  AND lower(trim(a.name)) = lower(trim(b.name)) AND lower(trim(a.email)) = lower(trim(b.email)))
UNION ALL SELECT -1""")
def f27_duplicates(spark, d):
    c = v.candidates(spark, d).withColumn("job_id", F.col("job_id") % 50)
    found = scope.duplicates_of(c.filter("id >= 5000"), c.filter("id < 5000")).select("id")
    return found.union(spark.range(1).select((F.col("id") - 1).alias("id")))


@register("""SELECT count(*) AS stuck FROM candidates WHERE stage IN ('SHORTLISTED', 'INTERVIEW_SCHEDULED') AND stage_entered_at < TIMESTAMP '2001-08-01 06:30:00' - INTERVAL 7 DAY""")
def f28_stuck_candidates(spark, d):
    return scope.stuck(v.candidates(spark, d), v.AS_OF).agg(F.count(F.lit(1)).alias("stuck"))


@register("""SELECT id, coalesce(last_login_at > TIMESTAMP '2001-08-01 06:30:00' - INTERVAL 15 MINUTE, false) AS online FROM users""")
def f29_online_users(spark, d):
    recent = F.col("last_login_at") > F.expr(f"timestamp'{v.AS_OF}' - interval 15 minutes")
    return v.users(spark, d).select("id", F.coalesce(recent, F.lit(False)).alias("online"))


@register("""SELECT id, created_at FROM candidates ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100""")
def l1_page(spark, d):
    return scope.page(v.candidates(spark, d).select("id", "created_at"), [F.col("created_at").desc(), F.col("id").desc()], page=3, limit=50)


@register("""SELECT id, scheduled_at FROM interviews ORDER BY scheduled_at DESC NULLS FIRST, id LIMIT 200 OFFSET 7""")
def l1_page_clamped(spark, d):
    order = [F.col("scheduled_at").desc_nulls_first(), F.col("id")]
    return scope.page(v.interviews(spark, d).select("id", "scheduled_at"), order, limit=5000, offset=7)


@register("""SELECT id, scheduled_at FROM interviews ORDER BY scheduled_at DESC NULLS FIRST, id OFFSET 40""")
def l2_offset_without_limit(spark, d):
    i = v.interviews(spark, d).select("id", "scheduled_at")
    key = F.struct(F.col("scheduled_at").isNotNull().alias("known"), (-F.unix_micros(F.col("scheduled_at").cast("timestamp"))).alias("at"), F.col("id"))
    return scope.beyond(i, key, (3 - 1) * 20).orderBy(F.col("scheduled_at").desc_nulls_first(), "id")


@register("""SELECT id, created_at FROM jobs ORDER BY created_at DESC, id""")
def l5_newest_first(spark, d):
    return scope.page(v.jobs(spark, d).select("id", "created_at"), [F.col("created_at").desc(), F.col("id")])


@register("""SELECT id, user_id, amount FROM ledger WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 20""")
def l6_last_transactions(spark, d):
    t = v.ledger(spark, d).filter("user_id = 7")
    return t.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(20).select("id", "user_id", "amount")


@register("""SELECT id, round(resume_score, 6) AS score FROM candidates WHERE resume_score >= 60""")
def l7_high_scorers(spark, d):
    c = v.candidates(spark, d).filter("resume_score >= 60")
    return c.orderBy(F.col("resume_score").desc(), "id").select("id", F.round("resume_score", 6).alias("score"))


@register("""SELECT id, array_to_string(skills[1:2], ',') AS skills FROM candidates WHERE skills IS NOT NULL""")
def l8_first_skills(spark, d):
    c = v.candidates(spark, d).filter("skills is not null")
    return c.select("id", F.array_join(F.slice("skills", 1, 2), ",").alias("skills"))
