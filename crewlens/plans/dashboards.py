"""Queries of dashboard metrics, funnels, indicators and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import scope
from ..operators import windows as w
from ..sources import views as v
from .sql_views import Register
from .stages import BOTH, LATEST, REPORTING, _reporting, both

register = Register()
TEN = "CASE WHEN interview_score > 10 THEN interview_score / 10 ELSE interview_score END"
DAYS = "floor(epoch({b} - {a}) / 86400)"
HIRED_AT = "coalesce(stage_updated_at, updated_at, created_at)"
IM = f"""im AS (SELECT CAST(count(*) FILTER (s IN ('scheduled', 'ongoing')) AS BIGINT) AS interviews_scheduled,
  count(*) FILTER (c.stage = 'SELECTED' OR (s = 'completed' AND coalesce(sc, 0) >= 6)) AS selected, count(*) FILTER (s = 'completed' AND coalesce(sc, 0) < 6) AS rejected,
  count(*) FILTER (s = 'completed') AS completed_interviews, count(*) FILTER (s = 'completed' AND coalesce(sc, 0) >= 6 AND coalesce(c.resume_score, 0) >= 80) AS offer_ready,
  round(coalesce(avg(sc), 0), 4) AS avg_interview_score
  FROM (SELECT candidate_id, lower(trim(coalesce(status, ''))) AS s, {TEN} AS sc FROM latest) l JOIN candidates c ON c.id = l.candidate_id"""


@register("""SELECT count(*) AS total_candidates, count(*) FILTER (stage = 'SHORTLISTED') AS shortlisted, count(*) FILTER (stage = 'RESUME_REJECTED') AS resume_rejected,
  count(*) FILTER (stage = 'SELECTED') AS selected, count(*) FILTER (stage = 'REJECTED') AS rejected, round(sum(resume_score), 2) AS resume_score_sum, count(resume_score) AS resume_score_count
FROM candidates WHERE stage <> 'APPLIED'""")
def a1_stage_metrics(spark, d):
    return m.stage_metrics(v.candidates(spark, d), exclude_applied=True)


@register(f"WITH {LATEST}, {IM}) SELECT * FROM im")
def a2_latest_interview_metrics(spark, d):
    return m.interview_metrics(v.candidates(spark, d), v.interviews(spark, d))


@register("""SELECT job_id, count(*) FILTER (stage <> 'APPLIED') AS candidates, count(*) FILTER (stage = 'SHORTLISTED') AS shortlisted, count(*) FILTER (stage = 'SELECTED') AS selected
FROM candidates WHERE job_id IS NOT NULL GROUP BY job_id""")
def a3_counts_by_job(spark, d):
    return m.counts_by_job(v.candidates(spark, d))


@register(f"""
WITH {LATEST}, {IM}), c AS (SELECT count(*) AS total, round(avg(resume_score), 1) AS avg_score FROM candidates WHERE created_at >= TIMESTAMP '2000-01-01'),
j AS (SELECT count(*) AS open_jobs FROM jobs WHERE is_active),
t AS (SELECT count(*) AS booked FROM (SELECT candidate FROM slots WHERE slot_date >= DATE '2001-08-01' UNION SELECT CAST(candidate_id AS VARCHAR) FROM interviews WHERE scheduled_at >= TIMESTAMP '2001-08-01'))
SELECT total, avg_score, open_jobs, interviews_scheduled, completed_interviews, booked FROM c, j, im, t""")
def a4_dashboard_stats(spark, d):
    c, i = v.candidates(spark, d), v.interviews(spark, d)
    total = c.filter("created_at >= timestamp'2000-01-01'").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("resume_score"), 1).alias("avg_score"))
    jobs = v.jobs(spark, d).filter("is_active").agg(F.count(F.lit(1)).alias("open_jobs"))
    im = m.interview_metrics(c, i).select("interviews_scheduled", "completed_interviews")
    a = v.slots(spark, d).filter("slot_date >= date'2001-08-01'").select("candidate")
    b = i.filter("scheduled_at >= timestamp'2001-08-01'").select(F.col("candidate_id").cast("string").alias("candidate"))
    booked = a.union(b).distinct().agg(F.count(F.lit(1)).alias("booked"))
    return total.crossJoin(F.broadcast(jobs)).crossJoin(F.broadcast(im)).crossJoin(F.broadcast(booked))  # one row each


@register(f"""WITH {LATEST}, {BOTH}, r AS (SELECT {REPORTING} AS stage FROM both_), s AS (SELECT unnest(['APPLIED', 'SHORTLISTED', 'RESUME_REJECTED', 'REVIEW', 'INTERVIEW_SCHEDULED', 'INTERVIEW_RESCHEDULED', 'INTERVIEWED', 'INTERVIEW_FAILED', 'INTERVIEW_REVIEW', 'NO_SHOW', 'SELECTED', 'REJECTED']) AS stage)
SELECT s.stage, (SELECT count(*) FROM r WHERE r.stage = s.stage) AS count FROM s""")
def a5_pipeline_stats(spark, d):
    from ..schema import STAGES

    counts = both(spark, d).groupBy(_reporting().alias("stage")).agg(F.count(F.lit(1)).alias("count"))
    return w.dense(STAGES, counts, "stage", "count").select("stage", "count")


@register(f"""
WITH {LATEST}, {IM} WHERE c.stage <> 'APPLIED'), c AS (SELECT greatest(count(*), 1) AS total, count(*) FILTER (stage = 'SHORTLISTED') AS sl FROM candidates),
r AS (SELECT 0 AS ordinal, 'Total Candidates' AS stage, total AS count FROM c UNION ALL SELECT 1, 'Shortlisted', sl FROM c UNION ALL SELECT 2, 'Interview Scheduled', interviews_scheduled FROM im
  UNION ALL SELECT 3, 'Selected', selected FROM im UNION ALL SELECT 4, 'Rejected', rejected FROM im)
SELECT ordinal, stage, count, round(count * 100.0 / (SELECT total FROM c), 1) AS percentage FROM r""")
def a6_hiring_funnel(spark, d):
    return m.hiring_funnel(v.candidates(spark, d), v.interviews(spark, d))


@register(f"""
WITH {LATEST}, b AS (SELECT c.*, l.status, l.interview_score FROM candidates c LEFT JOIN latest l ON l.candidate_id = c.id), s AS (SELECT *, {REPORTING} AS shown,
  greatest(0, floor(epoch(TIMESTAMP '2001-08-01 06:30:00' - coalesce(stage_entered_at, stage_updated_at, created_at)) / 86400)) AS days, lower(coalesce(offer_status, '')) AS o FROM b),
r AS (SELECT 0 AS ordinal, 'Applied' AS stage, count(*) AS n, avg(days) AS a FROM s UNION ALL SELECT 1, 'Screened', count(*), avg(days) FROM s WHERE stage <> 'APPLIED'
  UNION ALL SELECT 2, 'Shortlisted', count(*), avg(days) FROM s WHERE stage = 'SHORTLISTED' UNION ALL SELECT 3, 'Interviewed', count(*), avg(days) FROM s WHERE shown IN ('INTERVIEW_SCHEDULED', 'INTERVIEWED')
  UNION ALL SELECT 4, 'Selected', count(*), avg(days) FROM s WHERE shown = 'SELECTED' UNION ALL SELECT 5, 'Offered', count(*), avg(days) FROM s WHERE o IN ('made', 'accepted') UNION ALL SELECT 6, 'Hired', count(*), avg(days) FROM s WHERE o = 'accepted'),
x AS (SELECT *, lag(n) OVER (ORDER BY ordinal) AS p FROM r), y AS (SELECT *, CASE WHEN coalesce(p, 0) = 0 THEN CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END ELSE round(n * 100.0 / p, 1) END AS conv FROM x)
SELECT ordinal, stage, n AS count, CAST(conv AS DOUBLE) AS conversion, CAST(CASE WHEN coalesce(p, 0) = 0 THEN 0.0 ELSE greatest(0.0, round(100 - conv, 1)) END AS DOUBLE) AS dropoff, round(coalesce(a, 0), 1) AS avg_days FROM y""")
def a7_recruitment_funnel(spark, d):
    return m.recruitment_funnel(both(spark, d).withColumn("shown", _reporting()), v.AS_OF)


@register(f"""
WITH w(period, a, b) AS (VALUES (1, TIMESTAMP '2001-02-02 06:30:00', TIMESTAMP '2001-08-01 06:30:00'), (2, TIMESTAMP '2000-08-06 06:30:00', TIMESTAMP '2001-02-02 06:30:00')),
c AS (SELECT w.period, c.*, lower(coalesce(offer_status, '')) AS o FROM candidates c JOIN w ON c.created_at BETWEEN w.a AND w.b),
x AS (SELECT period, count(*) AS n, count(*) FILTER (o IN ('made', 'accepted')) AS rel, count(*) FILTER (o = 'accepted') AS acc, count(*) FILTER (stage = 'SELECTED') AS sel,
  count(*) FILTER (stage IN ('INTERVIEW_SCHEDULED', 'INTERVIEW_RESCHEDULED', 'INTERVIEWED', 'SELECTED', 'REJECTED')) AS itv, round(avg(greatest(0, {DAYS.format(a='created_at', b=HIRED_AT)})) FILTER (stage = 'SELECTED'), 1) AS tth FROM c GROUP BY period),
i AS (SELECT period, count(*) AS n FROM c JOIN interviews i ON i.candidate_id = c.id WHERE i.status IN ('scheduled', 'in_progress') GROUP BY period),
y AS (SELECT x.*, coalesce(i.n, 0) AS act, CASE WHEN acc > 0 THEN acc ELSE sel END AS hires, (SELECT count(*) FROM jobs WHERE is_active) AS oj FROM x LEFT JOIN i ON i.period = x.period),
z AS (SELECT period, unnest(['total_open_jobs', 'total_candidates', 'active_interviews', 'offers_released', 'offers_accepted', 'total_hires', 'avg_time_to_hire', 'offer_acceptance_rate', 'interview_to_hire_ratio']) AS key,
  unnest([CAST(oj AS DOUBLE), n, act, rel, acc, hires, coalesce(tth, 0), coalesce(round(acc * 100.0 / nullif(rel, 0), 1), 0), coalesce(round(itv * 1.0 / nullif(hires, 0), 2), 0)]) AS v FROM y),
q AS (SELECT key, max(v) FILTER (period = 1) AS value, max(v) FILTER (period = 2) AS previous FROM z GROUP BY key),
e AS (SELECT *, CASE WHEN previous = 0 THEN CASE WHEN value = 0 THEN 0.0 ELSE 100.0 END ELSE round((value - previous) * 100 / abs(previous), 1) END AS change_pct FROM q)
SELECT *, CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' ELSE 'flat' END AS trend FROM e""")
def a8_kpi_summary(spark, d):
    windows = scope.period_windows("last_6_months", v.AS_OF)
    return m.kpis(v.candidates(spark, d), v.interviews(spark, d), v.jobs(spark, d).filter("is_active"), windows)


@register(f"SELECT strftime(created_at, '%b') AS month, round(avg(greatest(1, {DAYS.format(a='created_at', b=HIRED_AT)})), 1) AS avg_days FROM candidates WHERE stage = 'SELECTED' GROUP BY 1")
def a9_time_to_hire(spark, d):
    return m.time_to_hire(v.candidates(spark, d))


@register("""
WITH s AS (SELECT unnest(skills) AS s, resume_score FROM candidates),
g AS (SELECT lower(trim(s)) AS l, resume_score FROM s WHERE NOT regexp_matches(s, '[%+0-9]') AND lower(trim(s)) <> 'engineering' AND length(s) BETWEEN 2 AND 30),
n AS (SELECT CASE l WHEN 'js' THEN 'javascript' WHEN 'react.js' THEN 'react' WHEN 'docker-compose' THEN 'docker' WHEN 'postgres' THEN 'postgresql' ELSE l END AS l, resume_score FROM g)
SELECT upper(l[1]) || l[2:] AS skill, count(*) AS count, round(coalesce(avg(nullif(resume_score, 0)), 0), 1) AS avg_score FROM n GROUP BY l ORDER BY count(*) DESC, l LIMIT 15""")
def a10_skill_heatmap(spark, d):
    return m.skill_heatmap(v.candidates(spark, d))


@register("""SELECT r AS range, (SELECT count(*) FROM candidates WHERE resume_score >= a AND resume_score <= b) AS count FROM (VALUES ('0-20', 0, 20), ('21-40', 21, 40), ('41-60', 41, 60), ('61-80', 61, 80), ('81-100', 81, 100)) t(r, a, b)""")
def a11_score_distribution(spark, d):
    return m.score_distribution(v.candidates(spark, d))


@register("SELECT strftime(created_at, '%b') AS month, round(avg(resume_score), 1) AS avg_score FROM candidates WHERE resume_score IS NOT NULL AND created_at >= TIMESTAMP '1997-01-01' GROUP BY 1")
def a12_resume_scores_trend(spark, d):
    c = scope.date_window(v.candidates(spark, d).filter("resume_score is not null"), "created_at", from_date="1997-01-01")
    return c.groupBy(m.month(F.col("created_at")).alias("month")).agg(F.round(F.avg("resume_score"), 1).alias("avg_score"))


@register("""SELECT strftime(i.created_at, '%b') AS month, round(coalesce(avg(CASE WHEN technical_score > 10 THEN technical_score / 10 ELSE technical_score END), 0), 1) AS technical,
  round(coalesce(avg(CASE WHEN communication_score > 10 THEN communication_score / 10 ELSE communication_score END), 0), 1) AS communication
FROM interviews i JOIN candidates c ON c.id = i.candidate_id WHERE coalesce(i.scheduled_at, i.created_at) >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def a13_interview_scores_trend(spark, d):
    from ..operators.pipeline import out_of_ten

    i = scope.date_window(v.interviews(spark, d), F.coalesce("scheduled_at", "created_at"), from_date="1998-01-01")
    i = i.join(v.candidates(spark, d).select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi")
    mean = lambda c: F.round(F.coalesce(F.avg(out_of_ten(F.col(c))), F.lit(0.0)), 1)
    return i.groupBy(m.month(F.col("created_at")).alias("month")).agg(mean("technical_score").alias("technical"), mean("communication_score").alias("communication"))


@register("""WITH h AS (SELECT job_id, count(*) FILTER (stage = 'SELECTED') AS h FROM candidates WHERE job_id IS NOT NULL GROUP BY job_id)
SELECT coalesce(nullif(department, ''), 'Other') AS department, CAST(sum(coalesce(h, 0)) AS BIGINT) AS hired, CAST(sum(greatest(0, coalesce(nullif(vacancies, 0), 1) - coalesce(h, 0))) AS BIGINT) AS open
FROM jobs j LEFT JOIN h ON h.job_id = j.id GROUP BY 1""")
def a14_hiring_by_department(spark, d):
    return m.hiring_by_department(v.jobs(spark, d), v.candidates(spark, d))


@register("SELECT source, count(*) AS count FROM candidates WHERE source IS NOT NULL GROUP BY source")
def a15_source_breakdown(spark, d):
    return v.candidates(spark, d).filter("source is not null").groupBy("source").count()


@register("SELECT decline_reason AS reason, count(*) AS count FROM candidates WHERE decline_reason IS NOT NULL GROUP BY decline_reason")
def a16_decline_reasons(spark, d):
    return v.candidates(spark, d).filter("decline_reason is not null").groupBy(F.col("decline_reason").alias("reason")).count()


@register("""SELECT count(*) FILTER (offer_status IN ('made', 'accepted')) AS offers_made, count(*) FILTER (offer_status = 'accepted') AS offers_accepted,
  round(count(*) FILTER (offer_status = 'accepted') * 100.0 / count(*) FILTER (offer_status IN ('made', 'accepted')), 1) AS acceptance_rate FROM candidates""")
def a17_offer_acceptance(spark, d):
    c = v.candidates(spark, d)
    a = c.agg(m.count_if(F.col("offer_status").isin("made", "accepted")).alias("offers_made"), m.count_if(F.col("offer_status") == "accepted").alias("offers_accepted"))
    return a.withColumn("acceptance_rate", m.ratio(F.col("offers_accepted"), F.col("offers_made")))


@register("""WITH c AS (SELECT job_id, count(*) FILTER (stage <> 'APPLIED') AS n, count(*) FILTER (stage = 'SHORTLISTED') AS s FROM candidates WHERE job_id IS NOT NULL GROUP BY job_id)
SELECT j.id, title, company_name, coalesce(nullif(vacancies, 0), 1) AS vacancies, n AS candidates, s AS selected, CASE WHEN coalesce(status, '') <> '' THEN status WHEN s >= coalesce(nullif(vacancies, 0), 1) THEN 'filled' ELSE 'open' END AS status
FROM jobs j JOIN c ON c.job_id = j.id WHERE is_active AND n > 0""")
def a18_active_jobs(spark, d):
    return m.active_jobs(v.jobs(spark, d), v.candidates(spark, d), admin=False)


@register(f"""
WITH {LATEST}, {IM}), a AS (SELECT count(*) FILTER (stage IN ('SHORTLISTED', 'INTERVIEW_SCHEDULED') AND stage_entered_at < TIMESTAMP '2001-08-01 06:30:00' - INTERVAL 7 DAY) AS stuck,
  count(*) FILTER (stage = 'SHORTLISTED' AND resume_score >= 85) AS ready FROM candidates),
s AS (SELECT count(*) AS stale FROM jobs WHERE is_active AND id NOT IN (SELECT job_id FROM candidates WHERE job_id IS NOT NULL AND created_at >= TIMESTAMP '2001-08-01 06:30:00' - INTERVAL 14 DAY)),
t AS (SELECT [stuck || ' candidate' || CASE WHEN stuck > 1 THEN 's' ELSE '' END || ' waiting over 7 days in pipeline - action needed',
  ready || ' high-scoring candidate' || CASE WHEN ready > 1 THEN 's' ELSE '' END || ' (85+) ready for interview scheduling',
  completed_interviews || ' interview' || CASE WHEN completed_interviews > 1 THEN 's' ELSE '' END || ' completed - pending hiring decision',
  stale || ' role' || CASE WHEN stale > 1 THEN 's' ELSE '' END || ' with no applications in 14 days - review job posting',
  offer_ready || ' strong candidate' || CASE WHEN offer_ready > 1 THEN 's' ELSE '' END || ' ready for offer - don''t lose them to competitors'] AS x FROM a, im, s)
SELECT array_to_string(list_filter(x, lambda y: NOT starts_with(y, '0 ')), '; ') AS insights FROM t""")
def a19_hiring_intelligence(spark, d):
    told = m.insights(v.candidates(spark, d), v.interviews(spark, d), v.jobs(spark, d), v.AS_OF)
    return told.select(F.array_join("insights", "; ").alias("insights"))


@register(f"""SELECT round(count(*) FILTER (stage = 'SELECTED') * 100.0 / count(*), 1) AS hire_rate, round(count(*) FILTER (stage <> 'APPLIED') * 100.0 / count(*), 1) AS screen_rate,
  (SELECT CAST(sum(coalesce(vacancies, 1)) AS BIGINT) FROM jobs WHERE is_active) AS positions, round(coalesce(avg(greatest(0, {DAYS.format(a='created_at', b=HIRED_AT)})) FILTER (stage = 'SELECTED'), 0), 1) AS avg_days FROM candidates""")
def a20_hiring_metrics(spark, d):
    days = F.greatest(F.lit(0), m.elapsed_days(F.col("created_at"), m.hired_at()))
    n = F.count(F.lit(1))
    c = v.candidates(spark, d).agg(
        m.ratio(m.count_if(F.col("stage") == "SELECTED"), n).alias("hire_rate"),
        m.ratio(m.count_if(F.col("stage") != "APPLIED"), n).alias("screen_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("stage") == "SELECTED", days)), F.lit(0.0)), 1).alias("avg_days"),
    )
    j = v.jobs(spark, d).filter("is_active").agg(F.sum(F.coalesce("vacancies", F.lit(1))).cast("long").alias("positions"))
    return c.crossJoin(F.broadcast(j))  # one row each


@register("""SELECT *, greatest(0, positions - filled) AS open FROM (SELECT count(DISTINCT nullif(trim(company_name), '')) AS companies, count(DISTINCT nullif(trim(company_name), '')) FILTER (is_active) AS active_companies,
  CAST(sum(coalesce(vacancies, 0)) AS BIGINT) AS positions, (SELECT count(*) FROM candidates WHERE stage = 'SELECTED') AS filled FROM jobs)""")
def a21_client_stats(spark, d):
    return m.client_stats(v.jobs(spark, d), v.candidates(spark, d))


@register("SELECT DISTINCT trim(company_name) AS company FROM jobs WHERE trim(coalesce(company_name, '')) <> ''")
def a22_client_names(spark, d):
    return v.jobs(spark, d).select(F.trim("company_name").alias("company")).filter("company <> ''").distinct()


@register("SELECT count(*) AS n FROM candidates WHERE stage = 'SELECTED' AND job_id IN (SELECT id FROM jobs WHERE lower(trim(company_name)) = 'nation_2')")
def a23_candidate_count(spark, d):
    c = scope.of_client(v.candidates(spark, d).filter("stage = 'SELECTED'"), v.jobs(spark, d), "NATION_2")
    return c.agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS n FROM jobs WHERE lower(status) = 'open' AND skills_json ILIKE '%java%'")
def a24_job_count(spark, d):
    return scope.filter_jobs(v.jobs(spark, d), skills="java", status="OPEN").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS n FROM interviews WHERE CAST(coalesce(scheduled_at, created_at) AS DATE) >= DATE '2000-01-01'")
def a25_interview_count(spark, d):
    return scope.date_window(v.interviews(spark, d), F.coalesce("scheduled_at", "created_at"), from_date="2000-01-01").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT j.id, count(c.id) AS candidate_count FROM jobs j LEFT JOIN candidates c ON c.job_id = j.id GROUP BY j.id")
def a26_candidates_per_job(spark, d):
    n = v.candidates(spark, d).filter("job_id is not null").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return v.jobs(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("candidate_count"))


@register("SELECT id, (SELECT count(*) FROM candidates c WHERE c.job_id = j.id AND stage <> 'APPLIED') AS n FROM (SELECT * FROM jobs ORDER BY created_at DESC, id LIMIT 25) j")
def a27_dashboard_job_counts(spark, d):
    newest = v.jobs(spark, d).orderBy(F.col("created_at").desc(), "id").limit(25).select("id")
    own = v.candidates(spark, d).filter("stage <> 'APPLIED'").join(F.broadcast(newest.withColumnRenamed("id", "job_id")), "job_id", "left_semi")  # 25 rows
    n = own.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return newest.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@register("SELECT lower(trim(status)) AS status, count(*) AS n FROM interviews GROUP BY 1")
def a28_interviews_by_status(spark, d):
    return v.interviews(spark, d).groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS total, count(*) FILTER (email_type LIKE 'shortlist%' OR email_type LIKE 'interview%') AS shortlists, count(*) FILTER (email_type LIKE 'reject%') AS rejections FROM messages")
def a39_message_stats(spark, d):
    kind = F.coalesce("email_type", F.lit(""))
    return v.messages(spark, d).agg(
        F.count(F.lit(1)).alias("total"), m.count_if(kind.rlike("^(shortlist|interview)")).alias("shortlists"), m.count_if(kind.startswith("reject")).alias("rejections")
    )


@register(f"""SELECT arg_max(k, x) AS slowest, round(max(x), 4) AS days FROM (SELECT unnest(['entered', 'hired']) AS k, unnest([avg({DAYS.format(a='created_at', b='stage_entered_at')}), avg({DAYS.format(a='created_at', b=HIRED_AT)})]) AS x FROM candidates)""")
def a40_slowest_step(spark, d):
    made = F.col("created_at")
    c = v.candidates(spark, d).agg(F.avg(m.elapsed_days(made, F.col("stage_entered_at"))).alias("entered"), F.avg(m.elapsed_days(made, m.hired_at())).alias("hired"))
    tall = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("x")) for k in ("entered", "hired")])).alias("r")).select("r.*")
    return tall.agg(F.max_by("k", "x").alias("slowest"), F.round(F.max("x"), 4).alias("days"))


@register("SELECT company_name, count(*) AS jobs, CAST(sum(coalesce(vacancies, 1)) AS BIGINT) AS positions FROM jobs GROUP BY company_name")
def a41_company_totals(spark, d):
    return v.jobs(spark, d).groupBy("company_name").agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.coalesce("vacancies", F.lit(1))).cast("long").alias("positions"))


@register("SELECT stage, decline_reason, count(*) AS n FROM candidates GROUP BY stage, decline_reason")
def a42_group_by_stage(spark, d):
    return v.candidates(spark, d).groupBy("stage", "decline_reason").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT stage, source, count(*) AS n, grouping(stage) + 2 * grouping(source) AS level FROM candidates GROUP BY CUBE (stage, source)")
def a43_cube(spark, d):
    level = (F.grouping("stage") + 2 * F.grouping("source")).cast("long")
    return v.candidates(spark, d).cube("stage", "source").agg(F.count(F.lit(1)).alias("n"), level.alias("level"))


@register("SELECT id, coalesce(stage_updated_at, updated_at, created_at) AS until, CAST(floor(epoch(coalesce(stage_updated_at, updated_at, created_at) - created_at) / 86400) AS BIGINT) AS days FROM candidates")
def d20_elapsed_days(spark, d):
    return v.candidates(spark, d).select("id", m.hired_at().alias("until"), m.elapsed_days(F.col("created_at"), m.hired_at()).alias("days"))


@register("SELECT strftime(created_at, '%b') AS month, strftime(created_at, '%Y-%m') AS ym, count(*) AS n FROM candidates GROUP BY ALL")
def d21_month_label(spark, d):
    c = F.col("created_at")
    return v.candidates(spark, d).groupBy(m.month(c).alias("month"), F.date_format(c, "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT id, upper(lower(status)[1]) || lower(status)[2:] AS label FROM interviews")
def t66_capitalise(spark, d):
    return v.interviews(spark, d).select("id", m.capitalised(F.col("status")).alias("label"))


@register("""SELECT a, b, CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 0.0 ELSE 100.0 END ELSE round((a - b) * 100.0 / abs(b), 1) END AS change FROM (SELECT id % 40 AS a, id % 7 AS b FROM activity)""")
def m22_delta(spark, d):
    x = v.activity(spark, d).select((F.col("id") % 40).alias("a"), (F.col("id") % 7).alias("b"))
    return x.withColumn("change", m.delta(F.col("a"), F.col("b")))
