"""Queries of plans, wallets, metered usage and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..operators import billing as b
from ..sources import views as v
from .sql_views import Register

register = Register()
LIMITS = {"interview": 40, "resume": 400, "job_post": None}
CATALOGUE = "plans AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in b.PLANS
) + ") AS p(plan, billing, price, interview, resume_score, job_post, user_add))"


@register(f"""WITH {CATALOGUE}, n AS (SELECT agency_id, count(*) AS users FROM users GROUP BY agency_id)
SELECT a.id AS agency_id, plan, billing, price, interview, resume_score, job_post, user_add, CASE billing WHEN 'yearly' THEN 365 ELSE 30 END AS days, price * coalesce(users, 0) AS total FROM agencies a JOIN plans ON true LEFT JOIN n ON n.agency_id = a.id""")
def b3_plans(spark, d):
    """What each plan would be for every agency: its limits, and its price for all the agency's users."""
    users = v.users(spark, d).groupBy("agency_id").agg(F.count(F.lit(1)).alias("users"))
    offered = F.array(*[F.struct(F.lit(x[0]).alias("plan"), F.lit(x[1]).alias("billing")) for x in b.PLANS])
    each = v.agencies(spark, d).select(F.col("id").alias("agency_id"), F.explode(offered).alias("o")).select("agency_id", "o.*")
    priced = each.join(b.plans(spark), ["plan", "billing"]).join(users, "agency_id", "left")
    return priced.withColumn("total", F.col("price") * F.coalesce("users", F.lit(0))).drop("users")


@register(f"""WITH {CATALOGUE}, w AS (SELECT id AS agency_id, CASE id % 2 WHEN 0 THEN 'starter' ELSE 'growth' END AS plan, CASE id % 3 WHEN 0 THEN 'yearly' ELSE 'monthly' END AS billing, CAST(id + 2 AS INT) AS users FROM agencies)
SELECT agency_id, plan, billing, price * users AS total_price, interview, resume_score, job_post, TIMESTAMP '2001-08-01 06:30:00' + to_days(CASE billing WHEN 'yearly' THEN 365 ELSE 30 END) AS expires_at FROM w JOIN plans USING (plan, billing)""")
def b1_subscribe(spark, d):
    wanted = v.agencies(spark, d).selectExpr("id as agency_id", "if(id % 2 = 0, 'starter', 'growth') as plan", "if(id % 3 = 0, 'yearly', 'monthly') as billing", "cast(id + 2 as int) as users")
    return b.subscribed(wanted, b.plans(spark), v.AS_OF)


@register("""SELECT user_id, CAST(sum(amount) AS BIGINT) AS used FROM ledger WHERE transaction_type = 'DEBIT' AND description LIKE 'Interview completed - Interview ID %' AND created_at >= TIMESTAMP '2024-01-10' GROUP BY user_id""")
def a32_billed_usage(spark, d):
    return b.billed_usage(v.ledger(spark, d), "2024-01-10 00:00:00")


@register("""WITH u AS (SELECT agency_id, feature, CAST(sum(amount) AS BIGINT) AS used FROM usage GROUP BY agency_id, feature), t AS (SELECT *, CASE feature WHEN 'interview' THEN 400 WHEN 'resume' THEN 4000 END AS total FROM u)
SELECT agency_id, feature, total, used, CASE WHEN total IS NOT NULL THEN greatest(total - used, 0) END AS remaining, total IS NULL AS unlimited, coalesce(total - used >= 5, true) AS can_use FROM t""")
def a33_usage_summary(spark, d):
    used = v.usage(spark, d).groupBy("agency_id", "feature").agg(F.sum("amount").alias("used"))
    t = used.withColumn("total", F.when(F.col("feature") == "interview", 400).when(F.col("feature") == "resume", 4000))
    return t.select("agency_id", "feature", "total", "used", b.remaining(F.col("total"), F.col("used")).alias("remaining"), F.col("total").isNull().alias("unlimited"), b.allowed(F.col("total"), F.col("used"), F.lit(5)).alias("can_use"))


@register("SELECT agency_id, count(*) FILTER (is_active) AS seats FROM users GROUP BY agency_id")
def a34_seats(spark, d):
    return b.seats(v.users(spark, d))


BILLABLE = "lower(trim(coalesce(status, ''))) = 'completed' OR coalesce(transcript, '') <> '' OR interview_score IS NOT NULL"


def _billable(spark, d):
    c = F.col
    return v.interviews(spark, d).withColumn("is_billable", b.billable(c("status"), F.lit(False), c("transcript"), F.lit(None).cast("string"), c("interview_score")))


@register(f"SELECT id, {BILLABLE} AS is_billable FROM interviews")
def m25_billable(spark, d):
    return _billable(spark, d).select("id", "is_billable")


@register(f"""WITH w AS (SELECT c.id AS candidate_id, coalesce(c.agency_id, j.agency_id) AS agency_id FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id), a AS (SELECT agency_id, min(id) AS user_id FROM users WHERE role = 'admin' GROUP BY agency_id),
p AS (SELECT DISTINCT a.user_id, w.agency_id, i.id AS interview_id, u.wallet_balance FROM interviews i JOIN w ON w.candidate_id = i.candidate_id JOIN a ON a.agency_id = w.agency_id JOIN users u ON u.id = a.user_id WHERE {BILLABLE}),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY interview_id) AS k FROM p WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.user_id = p.user_id AND l.description = 'Interview completed - Interview ID ' || p.interview_id))
SELECT user_id, agency_id, interview_id, CAST(greatest(coalesce(wallet_balance, 0) - k, 0) AS INT) AS balance_after FROM n""")
def m26_batch_charge(spark, d):
    return b.charges(_billable(spark, d), v.candidates(spark, d), v.jobs(spark, d), v.users(spark, d), v.ledger(spark, d))


@register("SELECT id, round(greatest(price - CASE id % 3 WHEN 0 THEN price * 15.0 / 100 WHEN 1 THEN 5000.0 ELSE 0.0 END, 0), 2) AS price FROM (SELECT id, CAST(wallet_balance AS DOUBLE) AS price FROM users)")
def m27_discount(spark, d):
    kind = F.when(F.col("id") % 3 == 0, "percentage").when(F.col("id") % 3 == 1, "amount")
    value = F.when(F.col("id") % 3 == 0, 15.0).otherwise(5000.0)
    return v.users(spark, d).select("id", b.discounted(F.col("wallet_balance").cast("double"), kind, value).alias("price"))


@register("""SELECT agency_id, feature, amount, id FROM (SELECT *, row_number() OVER (PARTITION BY agency_id, feature ORDER BY fresh DESC, id DESC) AS rn FROM (SELECT *, id % 10 = 0 AS fresh FROM usage)) WHERE rn = 1""")
def k4_upsert(spark, d):
    u = v.usage(spark, d).select("agency_id", "feature", "amount", "id")
    return b.upserted(u.filter("id % 10 <> 0"), u.filter("id % 10 = 0"), ["agency_id", "feature"], ["id"])


@register("""WITH RECURSIVE e AS (SELECT *, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 2592000) AS INT) AS cycle, CASE feature WHEN 'interview' THEN 40 WHEN 'resume' THEN 400 END AS lim FROM usage),
n AS (SELECT *, row_number() OVER (PARTITION BY agency_id, feature, cycle ORDER BY ts, id) AS k FROM e),
r AS (SELECT id, agency_id, feature, cycle, k, coalesce(amount <= lim, true) AS accepted, CASE WHEN coalesce(amount <= lim, true) THEN amount ELSE 0 END AS used FROM n WHERE k = 1
  UNION ALL SELECT n.id, n.agency_id, n.feature, n.cycle, n.k, coalesce(r.used + n.amount <= n.lim, true), r.used + CASE WHEN coalesce(r.used + n.amount <= n.lim, true) THEN n.amount ELSE 0 END
  FROM r JOIN n ON n.agency_id = r.agency_id AND n.feature = r.feature AND n.cycle = r.cycle AND n.k = r.k + 1)
SELECT id, cycle, accepted, CAST(used AS BIGINT) AS used_after FROM r""")
def b4_consume(spark, d):
    return b.consumed(v.usage(spark, d), LIMITS, "2024-01-01 00:00:00").select("id", "cycle", "accepted", "used_after")


@register("""WITH RECURSIVE n AS (SELECT user_id, action, id, ts, row_number() OVER (PARTITION BY user_id, action ORDER BY ts, id) AS k FROM activity),
r AS (SELECT user_id, action, id, k, ts AS last, true AS keep FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.action, n.id, n.k, CASE WHEN n.ts - r.last >= INTERVAL 7200 SECOND THEN n.ts ELSE r.last END, n.ts - r.last >= INTERVAL 7200 SECOND
  FROM r JOIN n ON n.user_id = r.user_id AND n.action = r.action AND n.k = r.k + 1)
SELECT id, user_id, action FROM r WHERE keep""")
def x1_dedupe_batch(spark, d):
    return b.first_within(v.activity(spark, d), ["user_id", "action"], 7200).select("id", "user_id", "action")


TEMPLATES = """templates AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 5 AS INT) END AS agency_id, 'S' || (s_suppkey % 4) AS status, s_suppkey % 7 <> 0 AS is_active, s_suppkey % 6 = 0 AS is_selected,
  s_suppkey % 5 = 0 AS is_default, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2000-01-01' + to_hours(s_suppkey) END AS updated_at, TIMESTAMP '1999-01-01' + to_hours(s_suppkey) AS created_at FROM supplier)"""


@register(f"""WITH {TEMPLATES}, w AS (SELECT a.id AS agency_id, x.status FROM agencies a, (SELECT unnest(['S0', 'S1', 'S2', 'S3']) AS status) x),
r AS (SELECT w.agency_id, w.status, t.id, row_number() OVER (PARTITION BY w.agency_id, w.status ORDER BY t.agency_id IS NULL, t.is_selected DESC, t.is_default DESC, t.updated_at DESC NULLS LAST, t.created_at DESC) AS rn
  FROM w JOIN templates t ON t.status = w.status AND t.is_active AND (t.agency_id IS NULL OR t.agency_id = w.agency_id))
SELECT agency_id, status, id AS template_id FROM r WHERE rn = 1""")
def w11_template_choice(spark, d):
    t = v.table(spark, d, "supplier").selectExpr(
        "s_suppkey as id", "if(s_suppkey % 3 = 0, null, cast(s_suppkey % 5 as int)) as agency_id", "concat('S', s_suppkey % 4) as status", "s_suppkey % 7 <> 0 as is_active", "s_suppkey % 6 = 0 as is_selected",
        "s_suppkey % 5 = 0 as is_default", "if(s_suppkey % 2 = 0, timestampadd(HOUR, s_suppkey, timestamp'2000-01-01'), null) as updated_at", "timestampadd(HOUR, s_suppkey, timestamp'1999-01-01') as created_at",
    )
    wanted = v.agencies(spark, d).select(F.col("id").alias("agency_id"), F.explode(F.array(*[F.lit(f"S{k}") for k in range(4)])).alias("status"))
    return b.template_choice(wanted, t)


TEN = "CASE WHEN {0} IS NOT NULL THEN round(least(greatest(CASE WHEN {0} > 10 THEN {0} / 10 ELSE {0} END, 0), 10), 1) END"


@register(f"SELECT id, {TEN.format('interview_score')} AS score FROM interviews")
def m1_score_to_ten(spark, d):
    return v.interviews(spark, d).select("id", s.to_ten(F.col("interview_score")).alias("score"))


@register(f"""SELECT id, CASE WHEN technical_score IS NOT NULL AND communication_score IS NOT NULL AND culture_fit_score IS NOT NULL
  THEN round({TEN.format('technical_score')} * 0.5 + {TEN.format('communication_score')} * 0.3 + {TEN.format('culture_fit_score')} * 0.2, 1) ELSE {TEN.format('interview_score')} END AS score FROM interviews""")
def m2_interview_score(spark, d):
    c = F.col
    return v.interviews(spark, d).select("id", s.interview_score(c("interview_score"), c("technical_score"), c("communication_score"), c("culture_fit_score")).alias("score"))


SHARE = "greatest(0.0, least(coalesce({}, 0) / 100.0, 1.0))"


@register(f"""WITH x AS (SELECT id, resume_score AS a, CAST(id % 120 AS DOUBLE) AS b, score_threshold AS c, CAST(id % 90 - 10 AS DOUBLE) AS e FROM candidates),
y AS (SELECT id, round(round({SHARE.format('a')} * 0.4, 4) + round({SHARE.format('b')} * 0.2, 4) + round({SHARE.format('c')} * 0.2, 4) + round({SHARE.format('e')} * 0.1, 4) + round({SHARE.format('100')} * 0.1, 4), 4) AS score FROM x)
SELECT id, score, round(score * 100, 2) AS percent FROM y""")
def m12_ranking(spark, d):
    c = v.candidates(spark, d)
    f = {"skill_score": F.col("resume_score"), "experience_score": (F.col("id") % 120).cast("double"), "tfidf_score": F.col("score_threshold"), "bm25_score": (F.col("id") % 90 - 10).cast("double"), "education_score": F.lit(100)}
    return c.select("id", s.ranking(f).alias("r")).select("id", "r.score", "r.percent")


@register("SELECT id, CASE WHEN id % 7 > 0 THEN round(round(greatest(0.0, least(coalesce(resume_score, 0.0) / (id % 7) * 100, 100.0)), 8), 2) ELSE 0.0 END AS share FROM candidates")
def m11_feature_share(spark, d):
    return v.candidates(spark, d).select("id", s.clamp_percent(F.col("resume_score"), F.col("id") % 7).alias("share"))


PHRASES = ("developed and led a team", "b.tech cs pursuing, reduced cost 20% and improved speed 30%", "electronics; managed, mentored, directed stakeholders team", "college web api, crud rest database", "microservices on kubernetes cloud aws architecture", "")
TEXT = "CASE id % 6 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(PHRASES)) + " END"


def _profiles(spark, d):
    text = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (F.col("id") % 6 + 1).cast("int"))
    return v.candidates(spark, d).withColumn("text", text).withColumn("years", (F.col("id") % 9).cast("double"))


@register("SELECT id, CASE id % 6 WHEN 1 THEN 8.0 WHEN 2 THEN 6.0 ELSE 0.0 END AS score FROM candidates")
def m7_education_score(spark, d):
    return _profiles(spark, d).select("id", s.education_score(F.col("text")).alias("score"))


@register("SELECT id, CASE id % 6 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 WHEN 2 THEN 4.0 ELSE 0.0 END AS score FROM candidates")
def m8_soft_skills_score(spark, d):
    return _profiles(spark, d).select("id", s.soft_skills_score(F.col("text")).alias("score"))


@register(f"""WITH x AS (SELECT id, {TEXT} AS t, CAST(id % 9 AS DOUBLE) AS y FROM candidates), z AS (SELECT *, CASE WHEN y >= 6 THEN 12.0 WHEN y >= 2 THEN 10 + (y - 2) * 2 / 4 ELSE y / 2 * 10 END AS base,
  CASE id % 6 WHEN 0 THEN 0.5 WHEN 3 THEN 1.5 ELSE 0.0 END AS act, CASE id % 6 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS l FROM x)
SELECT id, round(least(base + CASE WHEN t = '' THEN 0 ELSE act + CASE WHEN y >= 5 AND l >= 2 THEN 8 WHEN y >= 3 AND l >= 1 THEN 5 WHEN y >= 2 THEN 3 ELSE 0 END END, 35), 2) AS score FROM z""")
def m4_experience_score(spark, d):
    wanted = F.array(F.lit("CRUD"), F.lit("golang"))
    return _profiles(spark, d).select("id", s.experience_score(F.col("text"), F.col("years"), F.lit(2), F.lit(6), wanted).alias("score"))


@register(f"""SELECT id, CASE WHEN id % 6 = 5 THEN 0.0 ELSE round(CASE id % 6 WHEN 0 THEN 0.3 + 2 + 1 + 3 WHEN 1 THEN 3.0 WHEN 2 THEN 2 + 3.0 WHEN 3 THEN 0 ELSE 3 END
  + CASE WHEN id % 9 <= 3 THEN CASE id % 6 WHEN 3 THEN 9 ELSE 0 END ELSE CASE id % 6 WHEN 4 THEN 10 ELSE 0 END END, 2) END AS score FROM candidates""")
def m5_projects_score(spark, d):
    return _profiles(spark, d).select("id", s.projects_score(F.col("text"), F.col("years"), F.lit("analyst")).alias("score"))


@register("SELECT id, CAST(CASE id % 3 WHEN 0 THEN 7.0 WHEN 1 THEN 3.5 ELSE 0.0 END AS DOUBLE) AS score FROM jobs")
def m3_skills_score(spark, d):
    texts = ("Intro\nSkills\n- Python, SQL; k8s\nExperience\nBuilt python and sql tools. ok", "Deployed kubernetes on a cluster.\nSkills:\nk8s | git", "fresher\nSkills\npython")
    text = F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("id") % 3 + 1).cast("int"))
    wanted = F.when(F.col("id") % 3 == 1, F.array(F.lit("K8s"))).otherwise(F.array(F.lit("Python"), F.lit("sql")))
    return v.jobs(spark, d).select("id", s.skills_score(text, wanted, F.lit(0)).alias("score"))


@register("SELECT id, CASE id % 5 WHEN 0 THEN 5.0 WHEN 1 THEN 5.0 WHEN 2 THEN 2.5 WHEN 3 THEN 5.0 ELSE 0.0 END AS score FROM jobs")
def m14_location_score(spark, d):
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % 5 + 1).cast("int"))
    own, wanted = pick("Pune ", "Pune East", "x", "", "Delhi"), pick("pune", "Pune, India", " ", "Mumbai/Thane", "Pune")
    return v.jobs(spark, d).select("id", s.location_score(own, wanted, pick("", "", "", "moved to Thane", None)).alias("score"))


@register("SELECT id, CASE WHEN resume_score IS NULL THEN 40.0 WHEN id % 4 = 0 THEN 45.0 ELSE resume_score END AS score FROM candidates")
def m16_score_floor(spark, d):
    score = F.when(F.col("resume_score").isNotNull() & (F.col("id") % 4 == 0), 0.0).otherwise(F.col("resume_score"))
    return v.candidates(spark, d).select("id", s.score_floor(score, F.repeat(F.lit("x"), F.lit(101))).alias("score"))


@register("""SELECT id, 85 AS name, CASE id % 3 WHEN 0 THEN 85 WHEN 1 THEN 50 ELSE 0 END AS role, CASE id % 2 WHEN 0 THEN 85 ELSE 60 END AS location, CASE WHEN id % 9 = 0 THEN 50 ELSE 85 END AS experience, CASE WHEN skills IS NULL THEN 0 ELSE 90 END AS skills, 100 AS email,
  concat_ws(',', CASE WHEN id % 3 > 0 THEN 'role' END, CASE WHEN id % 9 = 0 THEN 'experience' END, CASE WHEN skills IS NULL THEN 'skills' END) AS hidden FROM candidates""")
def m17_field_confidence(spark, d):
    role = F.when(F.col("id") % 3 == 0, "QA Lead").when(F.col("id") % 3 == 1, "Chef")
    place = F.when(F.col("id") % 2 == 0, "Pune, India").otherwise("Pune")
    c = v.candidates(spark, d).select("id", s.field_confidence(F.col("name"), role, place, F.col("id") % 9, F.col("skills"), F.col("email")).alias("c"))
    return c.select("id", "c.name", "c.role", "c.location", "c.experience", "c.skills", "c.email", F.array_join("c.hidden_fields", ",").alias("hidden"))


@register("SELECT id, round(0.2 + 0.25 + CASE WHEN job_id IS NULL THEN 0 ELSE 0.25 END + CASE WHEN updated_at IS NULL THEN 0 ELSE 0.2 END + CASE WHEN id % 4 > 0 THEN 0.1 ELSE 0 END, 2) AS confidence FROM candidates")
def m21_entry_confidence(spark, d):
    c = F.col
    return v.candidates(spark, d).select("id", s.entry_confidence(c("name"), c("job_id"), c("created_at"), c("updated_at"), c("id") % 4).alias("confidence"))


@register("SELECT id, CASE WHEN skills IS NULL THEN 0.0 ELSE round(0.35 + CASE WHEN id % 2 = 0 THEN 0.35 ELSE 0 END + 0.05 * len(list_filter(skills, lambda s: lower(s) IN ('python', 'go'))) + 0.1, 2) END AS confidence FROM candidates")
def m18_skill_confidence(spark, d):
    found = F.array(F.lit("Python"), F.lit(" GO"))
    return v.candidates(spark, d).select("id", s.skill_confidence(F.col("skills"), found, F.col("id") % 2 == 0).alias("confidence"))


@register("SELECT id, CASE WHEN id % 5 = 0 THEN false ELSE id % 4 = 0 OR id % 7 > 3 OR (id % 2 = 0 AND id % 3 <> 0) OR (id % 5 > id % 4 AND id % 11 / 10.0 >= greatest(id % 13 / 10.0 - 0.05, 0)) END AS second FROM candidates")
def e7_second_layer(spark, d):
    n = lambda k: F.col("id") % k
    out = s.use_second_layer(n(4), n(5), F.lit(3), n(7), n(3) == 0, n(2) == 0, n(13) / 10, n(11) / 10)
    return v.candidates(spark, d).select("id", out.alias("second"))


@register("SELECT id, CASE WHEN resume_score >= 75 THEN 'Strong Fit' WHEN resume_score >= 55 THEN 'Potential Fit' WHEN resume_score >= 45 THEN 'Borderline Fit' ELSE 'Weak Fit' END AS label FROM candidates")
def m9_fit_label(spark, d):
    return v.candidates(spark, d).select("id", s.fit_label(F.col("resume_score")).alias("label"))
