"""Queries of résumé parts, ranks and further lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import resume as r
from ..functions import scoring as s
from ..functions import text as t
from ..operators import billing as b
from ..operators import pipeline as p
from ..operators import scope
from ..operators import windows as w
from ..sources import views as v
from ..sources.resumes import resumes
from .sql_views import Register

register = Register()
D = "coalesce(text, '')"
B = r"\s\x0B\p{Z}"


def _docs(spark, d):
    return v.table(spark, d, "documents")


ALONE = rf"({{0}} = '' OR regexp_matches({{0}}, '{r.HEADER_LINE}') OR regexp_matches({{0}}, '{r.CONTACT.replace('{', '{{').replace('}', '}}')}'))"


@register(rf"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(replace({D}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[{B}]+', ' ', 'g'))) AS l FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN x WHEN NOT {ALONE.format('x')} AND NOT {ALONE.format('l[i - 1]')} AND (regexp_matches(l[i - 1], '[,;|/(\-]$') OR regexp_matches(x, '^\p{{Ll}}')) THEN ' ' || x ELSE chr(10) || x END), '') AS x FROM l)
SELECT doc_id, md5(regexp_replace(regexp_replace(x, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{B}]+|[{B}]+$', '', 'g')) AS digest FROM j""")
def t8_merged_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(r.merged_lines(F.col("text"))).alias("digest"))


@register()
def t7_header_breaks(spark, d):
    return resumes(spark, d).select("id", F.md5(r.header_breaks(F.col("text"))).alias("digest"))


@register()
def t9_split_headers(spark, d):
    return resumes(spark, d).select("id", F.md5(r.split_headers(F.col("text"))).alias("digest"))


@register()
def t10_cleaned(spark, d):
    """The whole cleaning chain over the résumés."""
    return resumes(spark, d).select("id", F.md5(r.cleaned(F.col("text"))).alias("digest"))


@register()
def t19_title_bonus(spark, d):
    """The title of a job is the first line of a passage."""
    from .texts import _pairs

    title = F.trim(F.split_part("job", F.lit("\n"), F.lit(1)))
    return _pairs(spark, d).select("doc_id", r.title_bonus(F.col("text"), title).alias("bonus"))


@register("SELECT id, CASE id % 2 WHEN 0 THEN 'Python,SQL,k8s' ELSE '' END AS declared, id % 2 = 0 AS proven FROM jobs")
def t25_declared_skills(spark, d):
    body = F.when(F.col("id") % 2 == 0, "Intro\nTechnical Skills:\n- Python; SQL\n• k8s\nExperience\nBuilt SQL tools. ok").otherwise("SQL only. Built it")
    return v.jobs(spark, d).select("id", F.array_join(s.declared_skills(body), ",").alias("declared"), s.in_action(body, F.lit("sql")).alias("proven"))


@register("SELECT id, 'B.Tech CS' AS degree, 'Pune University' AS institution, CAST(2000 + id % 20 AS VARCHAR) AS year FROM jobs")
def t38_education(spark, d):
    body = F.concat(F.lit("notes\n\nB.Tech CS\nPune University, 1998 - "), (F.col("id") % 20 + 2000).cast("string"))
    e = v.jobs(spark, d).select("id", F.explode(r.education(body)).alias("e"))
    return e.select("id", "e.degree", F.split_part("e.institution", F.lit(","), F.lit(1)).alias("institution"), "e.year")


@register("SELECT id, 'AWS Certified ' || (id % 5) AS certifications, 'English,Hindi' AS languages FROM jobs")
def t40_certifications_and_languages(spark, d):
    c = F.concat(F.lit("- AWS Certified "), (F.col("id") % 5).cast("string"), F.lit("\naws certified "), (F.col("id") % 5).cast("string"), F.lit("\nhobbies; walking"))
    return v.jobs(spark, d).select("id", F.array_join(r.certifications(c), ",").alias("certifications"), F.array_join(r.languages(F.lit("English (fluent), HINDI - native / klingon; english")), ",").alias("languages"))


@register("SELECT id, 'Engineer ' || (id % 50) AS title, 'Pune' AS place FROM jobs")
def t45_job_fields(spark, d):
    body = F.concat(F.lit("Role: x\nJob Title: "), F.lower("title"), F.lit("\nLocation - pune -"))
    return v.jobs(spark, d).select("id", r.field_of(body, "job title", "role").alias("title"), r.field_of(body, "city", "location").alias("place"))


@register(rf"SELECT doc_id, left(array_to_string(list_filter(list_transform(string_split(replace(replace({D}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[{B}]+|[{B}]+$', '', 'g')), lambda x: x <> '')[1:15], chr(10)), 800) AS description FROM documents")
def t49_description(spark, d):
    return _docs(spark, d).select("doc_id", r.first_lines(F.col("text"), 15, 800).alias("description"))


@register("SELECT id, 'acme ' || (id % 7) || ' pvt ltd ' AS name FROM jobs")
def t67_plain_string(spark, d):
    return v.jobs(spark, d).select("id", r.plain_string(F.concat(F.lit("  ACME \t "), (F.col("id") % 7).cast("string"), F.lit(" Pvt Ltd. ;:"))).alias("name"))


@register("SELECT id, 2 AS n, CAST(2000 + id % 15 AS VARCHAR) || '-03-01' AS first, true AS running FROM jobs")
def d10_date_ranges(spark, d):
    body = F.concat(F.lit("Dev, Mar "), (F.col("id") % 15 + 2000).cast("string"), F.lit(" - June 2018; lead 07/2018 to Present; bad 2019 - 2001"))
    x = v.jobs(spark, d).select("id", r.date_ranges(body, 2030).alias("x"))
    return x.select("id", F.size("x").alias("n"), F.col("x")[0]["start"].cast("string").alias("first"), F.col("x")[1]["current"].alias("running"))


@register("SELECT id, least(round((((2018 - (2000 + id % 15)) * 12 + 3 + 1) + 25) / 12.0, 1), 40.0) AS years FROM jobs")
def d19_years_of_ranges(spark, d):
    body = F.concat(F.lit("Mar "), (F.col("id") % 15 + 2000).cast("string"), F.lit(" - June 2018; 07/2018 to Present"))
    return v.jobs(spark, d).select("id", r.years_of_ranges(r.date_ranges(body, 2030), F.lit("2020-07-01").cast("date")).alias("years"))


@register("""WITH r AS (SELECT user_id, value, ts, id FROM activity) SELECT id, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS place, dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS level, ntile(4) OVER (PARTITION BY user_id ORDER BY value DESC, id) AS quarter,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM r""")
def w12_ranks(spark, d):
    by = W.partitionBy("user_id").orderBy(F.col("value").desc())
    moving = F.avg("value").over(W.partitionBy("user_id").orderBy("ts", "id").rowsBetween(-2, 0))
    tiles = F.ntile(4).over(W.partitionBy("user_id").orderBy(F.col("value").desc(), "id"))
    return v.activity(spark, d).select("id", F.rank().over(by).alias("place"), F.dense_rank().over(by).alias("level"), tiles.alias("quarter"), F.round(moving, 4).alias("moving"))


@register("SELECT skill, count(*) AS n FROM (SELECT unnest(skills) AS skill FROM candidates) GROUP BY skill ORDER BY n DESC, skill LIMIT 15")
def l3_top_skills(spark, d):
    """A top list, cut on purpose."""
    skills = v.candidates(spark, d).select(F.explode("skills").alias("skill"))
    return skills.groupBy("skill").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "skill").limit(15)


@register("""SELECT i.id, i.status, CASE WHEN technical_score IS NOT NULL AND communication_score IS NOT NULL AND culture_fit_score IS NOT NULL THEN round(technical_score * 0.5 + communication_score * 0.3 + least(culture_fit_score / CASE WHEN culture_fit_score > 10 THEN 10 ELSE 1 END, 10) * 0.2, 1)
  WHEN interview_score IS NOT NULL THEN round(least(interview_score / CASE WHEN interview_score > 10 THEN 10 ELSE 1 END, 10), 1) END AS score FROM interviews i JOIN candidates c ON c.id = i.candidate_id WHERE c.assigned_to = 7 ORDER BY i.scheduled_at DESC NULLS FIRST, i.id LIMIT 50""")
def q5_interview_list(spark, d):
    mine = v.candidates(spark, d).filter("assigned_to = 7").select(F.col("id").alias("candidate_id"))
    own = v.interviews(spark, d).join(mine, "candidate_id", "left_semi")
    c = F.col
    page = scope.page(own, [c("scheduled_at").desc_nulls_first(), c("id")], page=1, limit=50)
    return page.select("id", "status", s.interview_score(c("interview_score"), c("technical_score"), c("communication_score"), c("culture_fit_score")).alias("score"))


@register("SELECT (SELECT count(*) FROM jobs) AS total, id, title FROM jobs ORDER BY created_at DESC, id LIMIT 100")
def q9_distribution_page(spark, d):
    jobs = v.jobs(spark, d)
    page = scope.page(jobs, [F.col("created_at").desc(), F.col("id")], page=1, limit=100).select("id", "title")
    return page.crossJoin(F.broadcast(jobs.agg(F.count(F.lit(1)).alias("total")))).select("total", "id", "title")  # one row


@register("SELECT m.id, m.email_type, m.status FROM messages m WHERE m.status = 'sent' AND m.email_type = 'offer_letter' AND EXISTS (SELECT 1 FROM candidates c WHERE c.id = m.candidate_id AND c.assigned_to < 50)")
def q10_messages(spark, d):
    mine = v.candidates(spark, d).filter("assigned_to < 50").select(F.col("id").alias("candidate_id"))
    return v.messages(spark, d).filter("status = 'sent' and email_type = 'offer_letter'").join(mine, "candidate_id", "left_semi").select("id", "email_type", "status")


@register("SELECT id, name, role FROM users WHERE agency_id = 1 AND is_active")
def q14_users_of_agency(spark, d):
    return v.users(spark, d).filter("agency_id = 1 and is_active").orderBy("role", "name", "id").select("id", "name", "role")


@register("SELECT id, amount, transaction_type FROM ledger WHERE user_id = 7")
def q16_transactions(spark, d):
    return v.ledger(spark, d).filter("user_id = 7").orderBy(F.col("created_at").desc(), "id").select("id", "amount", "transaction_type")


@register("""WITH x AS (SELECT id, user_id AS admin, amount % 40 AS percent, created_at FROM ledger WHERE transaction_type = 'CREDIT'), l AS (SELECT *, row_number() OVER (PARTITION BY admin ORDER BY created_at DESC, id DESC) AS rn FROM x)
SELECT l.id, coalesce(a.name, 'Unknown') AS agency, l.percent FROM l LEFT JOIN users u ON u.id = l.admin LEFT JOIN agencies a ON a.id = u.agency_id AND a.is_active WHERE l.rn = 1""")
def q18_discounts(spark, d):
    """The last discount given to each administrator, with the agency's name where it is known."""
    given = v.ledger(spark, d).filter("transaction_type = 'CREDIT'").select("id", F.col("user_id").alias("admin"), (F.col("amount") % 40).alias("percent"), "created_at")
    last = w.first_per_key(given, ["admin"], [F.col("created_at").desc(), F.col("id").desc()])
    users = v.users(spark, d).select(F.col("id").alias("admin"), "agency_id")
    names = v.agencies(spark, d).filter("is_active").select(F.col("id").alias("agency_id"), F.col("name").alias("agency"))
    return last.join(users, "admin", "left").join(F.broadcast(names), "agency_id", "left").select("id", F.coalesce("agency", F.lit("Unknown")).alias("agency"), "percent")  # five rows


@register("SELECT id, candidate_id FROM interviews WHERE is_async")
def q19_async_interviews(spark, d):
    return v.interviews(spark, d).filter("is_async").select("id", "candidate_id")


@register("SELECT candidate_id, id FROM interviews WHERE is_async")
def q19_async_by_candidate(spark, d):
    return v.interviews(spark, d).filter("is_async").select("candidate_id", "id")


@register("SELECT id, is_active AND (last_login_at IS NULL OR last_login_at >= TIMESTAMP '2001-08-01 06:00:00') AS valid FROM users")
def q20_token_validity(spark, d):
    live = F.col("is_active") & (F.col("last_login_at").isNull() | (F.col("last_login_at") >= F.lit("2001-08-01 06:00:00").cast("timestamp")))
    return v.users(spark, d).select("id", live.alias("valid"))


@register("SELECT agency_id, feature, coalesce(total - used >= 5, true) AS can_use FROM (SELECT agency_id, feature, CAST(sum(amount) AS BIGINT) AS used, CASE feature WHEN 'interview' THEN 1340 WHEN 'resume' THEN 1300 END AS total FROM usage GROUP BY agency_id, feature)")
def b5_access(spark, d):
    used = v.usage(spark, d).groupBy("agency_id", "feature").agg(F.sum("amount").alias("used"))
    total = F.when(F.col("feature") == "interview", 1340).when(F.col("feature") == "resume", 1300)
    return used.select("agency_id", "feature", b.allowed(total, F.col("used"), F.lit(5)).alias("can_use"))


@register("SELECT agency_id, id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY agency_id ORDER BY NOT (role = 'admin' AND is_active), created_at, id) AS rn FROM users) WHERE rn = 1")
def b2_scope_owner(spark, d):
    first = ~((F.col("role") == "admin") & F.col("is_active"))
    return w.first_per_key(v.users(spark, d), ["agency_id"], [first, F.col("created_at"), F.col("id")]).select("agency_id", F.col("id").alias("owner"))


@register("SELECT feature, period, n FROM (SELECT feature, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS after FROM usage GROUP BY feature) UNPIVOT (n FOR period IN (before, after))")
def a36_before_after(spark, d):
    cut = F.lit("2024-01-15").cast("timestamp")
    wide = v.usage(spark, d).groupBy("feature").agg(F.count_if(F.col("ts") < cut).alias("before"), F.count_if(F.col("ts") >= cut).alias("after"))
    return wide.unpivot(["feature"], ["before", "after"], "period", "n")


@register("SELECT stage, 'candidates' AS report, count(*) AS n FROM candidates GROUP BY stage UNION ALL SELECT coalesce(status, 'none'), 'interviews', count(*) FROM interviews GROUP BY status")
def a38_report(spark, d):
    count = F.count(F.lit(1)).alias("n")
    one = v.candidates(spark, d).groupBy("stage").agg(count).withColumn("report", F.lit("candidates"))
    two = v.interviews(spark, d).groupBy(F.coalesce("status", F.lit("none")).alias("stage")).agg(count).withColumn("report", F.lit("interviews"))
    return one.unionByName(two)


@register("SELECT id, job_id, name FROM candidates c WHERE EXISTS (SELECT 1 FROM messages m WHERE m.candidate_id = c.id AND m.status = 'sent' AND m.email_type = 'interview_invite') AND stage = 'INTERVIEW_RESCHEDULED'")
def p13_active_rescheduled(spark, d):
    sent = v.messages(spark, d).filter("status = 'sent' and email_type = 'interview_invite'").select(F.col("candidate_id").alias("id"))
    return v.candidates(spark, d).filter("stage = 'INTERVIEW_RESCHEDULED'").join(sent, "id", "left_semi").select("id", "job_id", "name")


@register("""SELECT id, CASE WHEN lower(trim(coalesce(status, ''))) = 'completed' OR async_completed_at IS NOT NULL OR transcript IS NOT NULL THEN 'completed' WHEN interview_score IS NOT NULL AND lower(trim(coalesce(status, ''))) = 'in progress' THEN 'completed' ELSE lower(trim(coalesce(status, ''))) END AS status FROM interviews""")
def p20_effective_status(spark, d):
    status = p.plain_status(F.col("status"))
    done = (status == "completed") | F.col("async_completed_at").isNotNull() | F.col("transcript").isNotNull() | (F.col("interview_score").isNotNull() & (status == "in progress"))
    return v.interviews(spark, d).select("id", F.when(done, "completed").otherwise(status).alias("status"))


@register("SELECT id, to_json(skills) AS skills FROM candidates WHERE to_json(skills) ILIKE '%NODE%'")
def c10_json_search(spark, d):
    return v.candidates(spark, d).select("id", F.to_json("skills").alias("skills")).filter(F.col("skills").ilike("%NODE%"))


@register("SELECT s.skill, o.related FROM (SELECT DISTINCT unnest(skills) AS skill FROM candidates) s JOIN (SELECT * FROM (VALUES ('python', 'java'), ('python', 'sql'), ('go', 'k8s')) AS o(skill, related)) o USING (skill)")
def c8_related_skills(spark, d):
    own = v.candidates(spark, d).select(F.explode("skills").alias("skill")).distinct()
    ontology = spark.createDataFrame([("python", "java"), ("python", "sql"), ("go", "k8s")], "skill string, related string")
    return own.join(ontology, "skill").select("skill", "related")


@register("SELECT id, md5('Cand ' || (id % 5000))[1:3] || '-' || id AS code FROM candidates")
def t62_candidate_code(spark, d):
    return v.candidates(spark, d).select("id", F.concat(F.left(F.md5("name"), F.lit(3)), F.lit("-"), F.col("id")).alias("code"))


@register(f"SELECT doc_id, length(md5({D})) AS n FROM documents WHERE regexp_matches({D}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')")
def t55_with_address(spark, d):
    return _docs(spark, d).filter(F.size(t.emails(F.col("text"))) > 0).select("doc_id", F.length(F.md5("text")).cast("long").alias("n"))
