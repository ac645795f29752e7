"""Queries of skills over a hierarchy, rescheduled candidates, merged records, summaries, final fit and page geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators import merging, pages, rescheduling, taxonomy
from ..sources import views as v
from .sql_views import Register
from .stages import CANON, SLOT_OF

register = Register()
PREFIX = "https://sessions.example/"
# A hierarchy of skills with a chain, two ways to one ancestor, and a cycle; synonyms, terms that are blocked.
PARENTS = (("react.js", "js"), ("node.js", "js"), ("js", "web"), ("html5", "web"), ("react.js", "frontend"), ("frontend", "web"), ("web", "programming"), ("programming", "web"), ("go", "programming"), ("python", "programming"), ("k8s", "containers"), ("docker-compose", "containers"), ("containers", "operations"), (None, "web"), ("go", "go"))
KNOWN = ("python", "js", "react.js", "c++", "html5", "node.js", "sql", "docker-compose", "git", "machine learning", "go", "java", "web", "programming")
SYNONYMS = ("k8s", "postgres")
BLOCKED = ("java", "excel")


def _values(rows, *names: str) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def _frame(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


CLOSURE = f"""edges AS (SELECT DISTINCT child, parent FROM {_values(PARENTS, 'child', 'parent')} WHERE child <> parent),
up AS (SELECT child, parent, 1 AS steps FROM edges UNION SELECT u.child, e.parent, u.steps + 1 FROM up u JOIN edges e ON e.child = u.parent WHERE u.steps < 8),
closed AS (SELECT child, parent, min(steps) AS steps FROM up WHERE child <> parent GROUP BY child, parent)"""


@register(f"""WITH RECURSIVE {CLOSURE}, s AS (SELECT id, i - 1 AS place, lower(trim(skills[i])) AS skill, id % 2 = 0 AS section, 'Profile ' || CASE WHEN id % 3 = 0 THEN skills[1] ELSE '' END AS header,
  CASE WHEN id % 6 > 1 THEN array_to_string(skills, ', ') ELSE '' END AS body, email, job_id FROM (SELECT *, unnest(range(1, len(skills) + 1)) AS i FROM candidates WHERE skills IS NOT NULL)),
k AS (SELECT skill, false AS synonym FROM {_values([(x,) for x in KNOWN], 'skill')} UNION ALL SELECT skill, true FROM {_values([(x,) for x in SYNONYMS], 'skill')}),
b AS (SELECT id, lower(skills[2]) AS skill FROM candidates WHERE id % 10 = 3),
m AS (SELECT s.*, synonym, regexp_matches(' ' || lower(header) || ' ', '[^a-z0-9_]' || regexp_escape(s.skill) || '[^a-z0-9_]') AS h, regexp_matches(' ' || lower(body) || ' ', '[^a-z0-9_]' || regexp_escape(s.skill) || '[^a-z0-9_]') AS t FROM s JOIN k ON k.skill = s.skill
  WHERE length(s.skill) >= 2 AND s.skill NOT IN ({', '.join(f"'{x}'" for x in BLOCKED)}) AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = s.id AND b.skill = s.skill)),
o AS (SELECT id, place, skill, CASE WHEN NOT synonym AND section THEN 'high' WHEN NOT synonym OR synonym OR t THEN 'medium' ELSE 'low' END AS label FROM m WHERE NOT (h AND NOT t)),
a AS (SELECT id, 0 AS added, place, 0 AS steps, skill AS name, skill, label FROM o UNION ALL SELECT id, 1, place, c.steps, c.parent, c.parent, 'medium' FROM o JOIN closed c ON c.child = o.skill),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id, skill ORDER BY added, place, steps, name, label) = 1)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY added, place, steps, name) AS place, skill, label, added = 1 AS added FROM f""")
def t37_final_skills(spark, d):
    """Skills of all candidates that are believed, and their ancestors in the hierarchy."""
    c = v.candidates(spark, d)
    header = F.concat(F.lit("Profile "), F.when(F.col("id") % 3 == 0, F.get("skills", F.lit(0))).otherwise(""))
    body = F.when(F.col("id") % 6 > 1, F.array_join("skills", ", ")).otherwise("")
    rows = c.select("id", header.alias("header"), body.alias("body"), (F.col("id") % 2 == 0).alias("from_section"), F.posexplode("skills").alias("place", "skill"))
    known = _frame(spark, [(x, False) for x in KNOWN] + [(x, True) for x in SYNONYMS], "skill string, synonym boolean")
    hierarchy = taxonomy.closure(_frame(spark, PARENTS, "child string, parent string"), "child", "parent")
    own = c.filter("id % 10 = 3").select("id", F.lower(F.get("skills", F.lit(1))).alias("skill"))
    return taxonomy.finalized(rows, "id", known, hierarchy, _frame(spark, [(x,) for x in BLOCKED], "skill string"), own)


EFFECTIVE = f"CASE WHEN trim(coalesce(async_link, '')) LIKE '{PREFIX}%' AND trim(coalesce(meeting_link, '')) = '' AND NOT is_async THEN scheduled_at - INTERVAL 330 MINUTE ELSE scheduled_at END"
RANK = "CASE {s} WHEN 'rescheduled' THEN 0 WHEN 'scheduled' THEN 1 WHEN 'ongoing' THEN 2 WHEN 'completed' THEN 3 WHEN 'no_show' THEN 3 WHEN 'selected' THEN 4 WHEN 'rejected' THEN 4 ELSE 1 END"
DAY = "2001-06-01"
NOW = f"{DAY} 06:30:00"
STAGE = "CASE WHEN {day} = DATE '" + DAY + "' THEN 'INTERVIEWED' WHEN {day} > DATE '" + DAY + "' THEN 'INTERVIEW_SCHEDULED' END"
SESSION_SLOTS = "SELECT l_orderkey AS candidate_id, CAST(l_shipdate AS DATE) AS slot_date, lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') || ':30:00' AS slot_time, l_shipdate - INTERVAL 20 DAY AS booked_at FROM lineitem WHERE l_linenumber = 2"


@register(f"""WITH {SLOT_OF}, c AS (SELECT id, stage_entered_at AS entered FROM candidates WHERE stage = 'INTERVIEW_RESCHEDULED'),
ls AS (SELECT candidate_id, slot_date, slot_time, created_at AS booked FROM slot_of JOIN c ON c.id = candidate_id QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY slot_date DESC, slot_time DESC NULLS FIRST, created_at DESC NULLS FIRST) = 1),
ri AS (SELECT candidate_id, {EFFECTIVE} + INTERVAL 330 MINUTE AS planned FROM interviews WHERE lower(trim(status)) = 'rescheduled' QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(scheduled_at, created_at) DESC NULLS LAST, coalesce(created_at, scheduled_at) DESC NULLS LAST, id) = 1),
s1 AS (SELECT c.id, {STAGE.format(day='slot_date')} AS stage FROM c JOIN ls ON ls.candidate_id = c.id LEFT JOIN ri ON ri.candidate_id = c.id
  WHERE coalesce(booked >= entered, false) OR (planned IS NOT NULL AND NOT (slot_date = CAST(planned AS DATE) AND coalesce(slot_time[1:5] = strftime(planned, '%H:%M'), true)))),
ss AS ({SESSION_SLOTS}),
s2 AS (SELECT * FROM (SELECT c.id, slot_date, slot_time, booked_at, {STAGE.format(day='slot_date')} AS stage FROM ss JOIN c ON c.id = ss.candidate_id WHERE NOT coalesce(booked_at < entered, false)) WHERE stage IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY slot_date DESC, slot_time DESC NULLS FIRST, booked_at DESC NULLS FIRST) = 1),
iv AS (SELECT c.id AS cid, i.*, {CANON} AS s FROM interviews i JOIN c ON c.id = i.candidate_id WHERE NOT coalesce(coalesce(i.created_at, i.scheduled_at) < entered, false)),
bi AS (SELECT * FROM iv QUALIFY row_number() OVER (PARTITION BY cid ORDER BY coalesce(scheduled_at, created_at) DESC NULLS LAST, coalesce(created_at, scheduled_at) DESC NULLS LAST, {RANK.format(s='s')} DESC, id) = 1),
s3 AS (SELECT cid AS id, CASE WHEN s IN ('completed', 'ongoing') THEN 'INTERVIEWED' WHEN s NOT IN ('scheduled', 'rescheduled') THEN NULL WHEN scheduled_at IS NULL THEN 'INTERVIEW_SCHEDULED'
  WHEN CAST(scheduled_at + INTERVAL 330 MINUTE AS DATE) < DATE '{DAY}' THEN NULL WHEN CAST(scheduled_at + INTERVAL 330 MINUTE AS DATE) > DATE '{DAY}' THEN 'INTERVIEW_SCHEDULED' WHEN scheduled_at + INTERVAL 360 MINUTE > TIMESTAMP '{DAY} 12:00:00' THEN 'INTERVIEWED' END AS stage FROM bi)
SELECT c.id AS candidate_id, coalesce(s1.stage, s2.stage, s3.stage) AS stage, CASE WHEN s1.stage IS NOT NULL THEN 'slot' WHEN s2.stage IS NOT NULL THEN 'session' ELSE 'interview' END AS via
FROM c LEFT JOIN s1 ON s1.id = c.id LEFT JOIN s2 ON s2.id = c.id LEFT JOIN s3 ON s3.id = c.id WHERE coalesce(s1.stage, s2.stage, s3.stage) IS NOT NULL""")
def p12_synced_stages(spark, d):
    """The stage of every rescheduled candidate by its slots, the slots of its sessions, or its interviews."""
    sessions = v.table(spark, d, "lineitem").filter("l_linenumber = 2").selectExpr(
        "l_orderkey as candidate_id", "to_date(l_shipdate) as slot_date", "concat(lpad(cast(l_partkey % 24 as string), 2, '0'), ':30:00') as slot_time", "timestampadd(DAY, -20, l_shipdate) as booked_at"
    )
    slots = v.slots(spark, d).withColumnsRenamed({"candidate": "Candidate_Id", "slot_date": "SlotDate", "slot_time": "time", "created_at": "Created_At"})
    return rescheduling.synced(v.candidates(spark, d), slots, sessions, v.interviews(spark, d), NOW, PREFIX)


RECORDS = """r AS (SELECT id, CASE WHEN id % 3 > 0 THEN email END AS email, 'Cand ' || (id % 400) AS name, CASE WHEN id % 4 > 0 THEN job_id % 50 END AS job_id, CASE WHEN id % 5 = 0 THEN 'INTERVIEWED' ELSE stage END AS stage,
  CASE WHEN id % 2 = 0 THEN resume_score END AS resume_score, CASE WHEN id % 7 < 2 THEN source END AS current_role, CASE WHEN id % 6 = 1 THEN skills END AS skills, TIMESTAMP '1998-01-01' + to_days(CAST(id % 3 AS INT)) AS created_at FROM candidates)"""
FILLED = {"email": "email IS NOT NULL", "job_id": "job_id IS NOT NULL", "resume_score": "resume_score IS NOT NULL", "current_role": "current_role IS NOT NULL", "skills": "len(skills) > 0"}
POINTS = lambda w: " + ".join(f"CASE WHEN coalesce({FILLED[c]}, false) THEN {n} ELSE 0 END" for c, n in w.items() if c in FILLED)
WEIGHT = "CASE stage " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in merging.STAGE_WEIGHTS.items()) + " ELSE 0 END"
FIELDS = ("email", "job_id", "resume_score", "current_role", "skills")


@register(f"""WITH {RECORDS}, p AS (SELECT *, {WEIGHT} + {POINTS(merging.PREFERRED)} AS pref, {POINTS(merging.COMPLETE)} AS compl, stage IN {merging.INTERVIEW_STAGES} AS owned FROM r),
q AS (SELECT *, owned AND compl <= 4 AS ph, CASE WHEN owned AND job_id IS NOT NULL THEN coalesce('e' || lower(email), 'n' || lower(name)) || ':' || job_id END AS k1, lower(name) || CAST(created_at AS DATE) AS k2 FROM p),
b1 AS (SELECT k1, id AS i1, ph AS ph1 FROM q WHERE k1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k1 ORDER BY pref + compl DESC, id) = 1),
b2 AS (SELECT k2, id AS i2 FROM q WHERE NOT ph QUALIFY row_number() OVER (PARTITION BY k2 ORDER BY compl DESC, id) = 1),
t AS (SELECT q.*, coalesce(CASE WHEN ph OR ph1 THEN nullif(i1, id) END, CASE WHEN ph THEN nullif(i2, id) END) AS goes FROM q LEFT JOIN b1 ON b1.k1 = q.k1 LEFT JOIN b2 ON b2.k2 = q.k2),
u AS (SELECT t.*, coalesce(o.id, t.id) AS root FROM t LEFT JOIN t o ON o.id = t.goes AND o.goes IS NULL)
SELECT root AS id, {', '.join(f"arg_max({c}, (CASE WHEN id = root THEN 1 ELSE 0 END, pref, -id)) FILTER ({FILLED[c]})" + f" AS {c}" if c != 'skills' else f"array_to_string(arg_max({c}, (CASE WHEN id = root THEN 1 ELSE 0 END, pref, -id)) FILTER ({FILLED[c]}), ',') AS {c}" for c in FIELDS)},
  arg_max(stage, (pref, CASE WHEN id = root THEN 1 ELSE 0 END, -id)) AS stage, arg_max(created_at, (pref, CASE WHEN id = root THEN 1 ELSE 0 END, -id)) AS created_at, count(*) - 1 AS merged FROM u GROUP BY root""")
def c11_merged_records(spark, d):
    """All candidates with records of one person merged; fields that a record lacks come from those merged into it."""
    c = v.candidates(spark, d)
    records = c.selectExpr(
        "id", "if(id % 3 > 0, email, null) as email", "concat('Cand ', id % 400) as name", "if(id % 4 > 0, job_id % 50, null) as job_id", "if(id % 5 = 0, 'INTERVIEWED', stage) as stage", "if(id % 2 = 0, resume_score, null) as resume_score",
        "if(id % 7 < 2, source, null) as current_role", "if(id % 6 = 1, skills, null) as skills", "timestampadd(DAY, id % 3, timestamp'1998-01-01') as created_at",
        "cast(null as timestamp) as stage_entered_at", "cast(null as timestamp) as stage_updated_at",
    )
    return merging.merged(records, FIELDS, ["created_at"]).withColumn("skills", F.array_join("skills", ","))


TITLED = lambda c, n: f"array_to_string(list_transform({c}[1:{n}], lambda x: array_to_string(list_transform(regexp_extract_all(x, '[a-z]+|[^a-z]+'), lambda y: upper(y[1:1]) || y[2:]), '')), ', ')"
SAY = lambda name, *what: " || ".join(what[int(x)] if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(sc.re.split(r"\{(\d)\}", sc.SENTENCES[name])) if x)


@register(f"""WITH x AS (SELECT c.id, list_transform(coalesce(c.skills, []), lambda y: lower(trim(y))) AS mine, list_transform(from_json(j.skills_json, '["VARCHAR"]'), lambda y: lower(trim(y))) AS wanted,
  ['git', 'go', 'excel'][1:c.id % 4] AS liked, CASE WHEN c.id % 3 = 0 THEN ['lead engineer', 'qa'] WHEN c.id % 3 = 1 THEN ['engineer ' || (j.id % 50)] ELSE [] END AS roles, CASE WHEN c.id % 7 = 0 THEN ['retail banking'] ELSE [] END AS fields, CASE WHEN c.id % 5 = 0 THEN 'Banking' ELSE '' END AS industry,
  lower(j.title) AS title, CAST(c.id % 9 AS DOUBLE) AS y, CASE j.id % 4 WHEN 1 THEN 3.0 WHEN 2 THEN 3.0 WHEN 3 THEN 4.0 END AS a, CASE j.id % 4 WHEN 2 THEN 6.0 WHEN 3 THEN 4.0 END AS b FROM candidates c JOIN jobs j ON j.id = c.job_id),
f AS (SELECT *, list_filter(wanted, lambda w: list_contains(mine, w)) AS hit, list_filter(wanted, lambda w: NOT list_contains(mine, w)) AS miss, list_filter(liked, lambda w: list_contains(mine, w)) AS extra,
  list_filter(fields, lambda w: contains(w, 'banking')) AS near, list_filter(roles, lambda w: contains(w, title) OR contains(title, w)) AS titles, printf('%.1f', y) AS ys, printf('%.1f', a) AS az, printf('%.1f', b) AS bz FROM x),
g AS (SELECT id, CASE WHEN a IS NULL THEN {SAY('no_range', 'ys')} WHEN b IS NULL THEN CASE WHEN y >= a THEN {SAY('at_least', 'ys', 'az')} ELSE {SAY('too_few', 'ys', 'az')} END WHEN y < a THEN {SAY('below', 'ys', 'az', 'bz')} WHEN y > b THEN {SAY('above', 'ys', 'az', 'bz')} ELSE {SAY('in_range', 'ys', 'az', 'bz')} END AS experience,
  CASE WHEN len(hit) > 0 THEN {SAY('skills', TITLED('hit', 4))} || CASE WHEN len(extra) > 0 THEN {SAY('preferred', TITLED('extra', 3))} ELSE '' END ELSE {SAY('no_skills')} END AS skills,
  CASE WHEN industry <> '' THEN CASE WHEN len(near) > 0 THEN {SAY('domain', TITLED('near', 2))} ELSE {SAY('no_domain', 'industry')} END WHEN len(roles) > 0 THEN CASE WHEN len(titles) > 0 THEN {SAY('roles', TITLED('titles', 2))} ELSE {SAY('no_roles')} END ELSE {SAY('unclear')} END AS domain,
  concat_ws(', ', CASE WHEN len(hit) > 0 THEN {SAY('core', TITLED('hit', 3))} END, CASE WHEN len(extra) > 0 THEN {SAY('extra', TITLED('extra', 2))} END, CASE WHEN y >= a THEN {SAY('deep')} WHEN y > 0 THEN {SAY('practical')} END, CASE WHEN len(roles) > 0 THEN {SAY('continuity', TITLED('roles', 2))} END) AS good,
  concat_ws(', ', CASE WHEN len(miss) > 0 THEN {SAY('missing', TITLED('miss', 4))} END, CASE WHEN y < a THEN {SAY('short')} END, CASE WHEN industry <> '' AND len(fields) = 0 THEN {SAY('no_background')} END) AS bad,
  CASE WHEN len(hit) >= 0.7 * len(wanted) AND len(wanted) > 0 AND coalesce(y >= a, true) THEN {SAY('strong')} WHEN len(hit) >= 0.4 * len(wanted) AND len(wanted) > 0 THEN {SAY('moderate')} ELSE {SAY('limited')} END AS fit, len(wanted) = 0 AND len(mine) = 0 AND y = 0 AND len(roles) = 0 AS blank FROM f),
h AS (SELECT *, CASE WHEN good <> '' THEN {SAY('strengths', 'good')} ELSE {SAY('no_strengths')} END AS strengths, CASE WHEN bad <> '' THEN {SAY('gaps', 'bad')} ELSE {SAY('no_gaps')} END AS gaps FROM g)
SELECT id, experience, skills, domain, strengths, gaps, fit, CASE WHEN blank THEN '{sc.NO_SUMMARY.replace(chr(10), "' || chr(10) || '")}' ELSE 'Candidate Summary:' || chr(10) || '• Experience Match: ' || experience || chr(10) || '• Skill Match: ' || skills || chr(10) || '• Domain Match: ' || domain || chr(10) || '• Strengths: ' || strengths || chr(10) || '• Gaps (if any): ' || gaps || chr(10) || '• Overall Fit: ' || fit END AS text FROM h""")
def t60_summary(spark, d):
    """The whole summary of every candidate that has a job."""
    jobs = v.jobs(spark, d).select(F.col("id").alias("job_id"), F.col("title").alias("job_title"), F.from_json("skills_json", "array<string>").alias("wanted"))
    both = v.candidates(spark, d).join(jobs, "job_id")
    i, j = F.col("id"), F.col("job_id")
    none = F.array().cast("array<string>")
    asked = F.when(j % 4 == 1, "3+ years").when(j % 4 == 2, "6 to 3 years").when(j % 4 == 3, "4")
    roles = F.when(i % 3 == 0, F.array(F.lit(" Lead  Engineer"), F.lit("QA"), F.lit("qa"))).when(i % 3 == 1, F.array("job_title")).otherwise(none)
    fields = F.when(i % 7 == 0, F.array(F.lit("Retail Banking"))).otherwise(none)
    liked = F.slice(F.array(F.lit("Git"), F.lit("GO"), F.lit("excel")), F.lit(1), (i % 4).cast("int"))
    told = sc.summary(F.col("wanted"), F.col("skills"), i % 9, sc.required_years(asked), liked, roles, fields, F.col("job_title"), F.when(i % 5 == 0, "Banking"))
    return both.select("id", told.alias("s")).select("id", "s.*")


OTHER_PROFESSIONS = ("excel", "machine learning", "git", "engineering")


@register(f"""WITH x AS (SELECT c.id, list_transform(c.skills, lambda y: lower(y)) AS mine, list_transform(from_json(j.skills_json, '["VARCHAR"]'), lambda y: lower(y)) AS wanted, coalesce(resume_score, 0) AS rs, coalesce(score_threshold, 40) AS st,
  CAST(date_diff('day', c.created_at, TIMESTAMP '2001-08-01') AS DOUBLE) / 365 AS years, source, j.city, j.state, c.agency_id FROM candidates c JOIN jobs j ON j.id = c.job_id),
y AS (SELECT *, len(list_filter(wanted, lambda w: list_contains(coalesce(mine, []), w))) AS matched, len(wanted) AS n, len(list_filter({list(OTHER_PROFESSIONS)}, lambda w: contains(array_to_string(coalesce(mine, []), ' '), w))) AS ignored FROM x),
f AS (SELECT id, matched, n AS wanted, ignored, round(years, 1) AS years, round(100.0 * matched / n, 1) AS skills, least(100.0, round(years * 20, 1)) AS experience, round(least(100.0, rs * 2), 1) AS tfidf, st AS bm25, CASE WHEN source IS NULL THEN 30.0 ELSE 90.0 END AS education,
  round(least(100.0, rs * 1.5), 1) AS combined, CASE WHEN lower(trim(city)) = '' THEN 2.5 WHEN agency_id IS NULL THEN 0.0 WHEN contains(['pune', 'mumbai', 'delhi', 'oslo', 'chennai'][agency_id + 1], lower(trim(city))) THEN 5.0 ELSE 0.0 END AS place, trim(city) <> '' AS named FROM y),
g AS (SELECT *, round(.4 * least(skills / 100, 1), 4) + round(.2 * least(experience / 100, 1), 4) + round(.2 * least(tfidf / 100, 1), 4) + round(.1 * least(bm25 / 100, 1), 4) + round(.1 * least(education / 100, 1), 4) AS total FROM f),
p AS (SELECT *, round(round(total, 4) * 100, 2) AS percent, round(experience / 100 * 20, 2) AS ex, round(education / 100 * 5, 2) AS ed FROM g),
q AS (SELECT *, CASE WHEN matched = 0 AND ignored >= 2 THEN least(percent, 35) WHEN matched <= 1 AND ignored >= 3 THEN least(percent, 45) ELSE percent END AS score FROM p),
h AS (SELECT *, list_filter([CASE WHEN skills >= 80 THEN 'Excellent skills match: ' || matched || ' of ' || wanted || ' required skills' WHEN skills >= 50 THEN 'Good skills match: ' || skills || '%' END, CASE WHEN ex >= 12 THEN years || ' years of relevant experience' END, CASE WHEN ed >= 4 THEN 'Education: relevant' END,
    CASE WHEN combined >= 60 THEN 'Strong resume-to-JD similarity: ' || combined || '%' END, CASE WHEN place >= 5 THEN 'Location aligns with job requirement' END], lambda x: x IS NOT NULL) AS good,
  list_filter([CASE WHEN skills < 50 THEN 'Missing ' || (wanted - matched) || ' key skills from requirements' END, CASE WHEN ex < 8 THEN 'Experience level appears below the role expectation' END, CASE WHEN ed < 2.5 THEN 'Education background not clearly relevant' END, CASE WHEN named AND place = 0 THEN 'Location does not align with job requirement' END], lambda x: x IS NOT NULL) AS bad FROM q)
SELECT id, round(score, 1) AS score, CASE WHEN score >= 80 THEN 'Strong Fit' WHEN score >= 65 THEN 'Potential Fit' WHEN score >= 50 THEN 'Borderline Fit' ELSE 'Weak Fit' END AS label, CASE WHEN score >= 65 THEN 'shortlisted' WHEN score >= 50 THEN 'review' ELSE 'rejected' END AS status,
  CASE WHEN len(good) > 0 THEN array_to_string(good, '; ') ELSE 'Basic qualifications present' END AS strengths, CASE WHEN len(bad) > 0 THEN array_to_string(bad, '; ') ELSE 'No significant gaps identified' END AS gaps FROM h""")
def m13_final_fit(spark, d):
    """The final judgement of every candidate that has a job: features from skills, time, scores and places, their ranking, caps, and reasons."""
    jobs = v.jobs(spark, d).select(F.col("id").alias("job_id"), F.from_json("skills_json", "array<string>").alias("wanted"), "city")
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    own, wanted = low(F.col("skills")), low(F.col("wanted"))
    score = F.coalesce("resume_score", F.lit(0.0))
    towns = F.array(*[F.lit(x) for x in ("pune", "mumbai", "delhi", "oslo", "chennai")])
    both = v.candidates(spark, d).join(jobs, "job_id").select(
        "id", "city", own.alias("own"), wanted.alias("wanted"), score.alias("rs"), F.coalesce("score_threshold", F.lit(40.0)).alias("bm25"), F.when(F.col("source").isNull(), 30.0).otherwise(90.0).alias("education"),
        (F.datediff(F.lit("2001-08-01").cast("date"), "created_at").cast("double") / 365).alias("y"), F.get(towns, F.col("agency_id")).alias("town"),
    ).select(
        "id", "city", "town", "bm25", "education", F.size("wanted").alias("n"), F.size(F.array_intersect("own", "wanted")).alias("matched"), F.round("y", 1).alias("years"), F.least(F.lit(100.0), F.round(F.col("y") * 20, 1)).alias("experience"),
        F.round(F.least(F.lit(100.0), F.col("rs") * 2), 1).alias("tfidf"), F.round(F.least(F.lit(100.0), F.col("rs") * 1.5), 1).alias("combined"), sc.contains_count(F.array_join("own", " "), OTHER_PROFESSIONS).alias("ignored"),
    ).withColumn("skills", F.round(100.0 * F.col("matched") / F.col("n"), 1))
    ranked = sc.ranking({name: F.col(c) for name, c in zip(sc.WEIGHTS, ("skills", "experience", "tfidf", "bm25", "education"), strict=True)})
    place = sc.location_score(F.col("town"), F.col("city"))
    features = F.struct(*[F.col(c) for c in ("skills", "experience", "tfidf", "bm25", "education", "combined")])
    fit = sc.final_fit(ranked["percent"], features, F.col("matched"), F.col("n"), F.col("ignored"), F.col("years"), place, F.trim("city") != "", F.lit("relevant"))
    c = both.select("id", fit.alias("f"))
    return c.select("id", "f.score", "f.label", "f.status", F.array_join("f.strengths", "; ").alias("strengths"), F.array_join("f.gaps", "; ").alias("gaps"))


WIDTH, WORDS_A_LINE, LINES_A_PAGE = 600.0, 5, 120
WORDS = f"""w AS (SELECT doc_id AS doc, i - 1 AS n, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM documents))),
r AS (SELECT *, n // {WORDS_A_LINE} AS row, n % {WORDS_A_LINE} AS j FROM w),
pw AS (SELECT doc, row // {LINES_A_PAGE} AS page, n, text, CASE WHEN doc % 3 = 0 THEN 40.0 ELSE 40.0 + row % 2 * 240.0 END + j * CASE WHEN doc % 3 > 0 AND row % 2 = 0 THEN 35.0 ELSE 50.0 END AS x0,
  (row % {LINES_A_PAGE}) // 2 * 12.0 + (n * 7 % 3) * 1.5 AS top FROM r),
ws AS (SELECT *, x0 + least(30.0, length(text) * 4.0) AS x1 FROM pw)"""


def _words(spark, d):
    """Words of the documents as words of pages, most of them in two columns, whose heights waver."""
    t = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    w = v.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(t).alias("n", "text"))
    row, j = F.floor(F.col("n") / WORDS_A_LINE), F.col("n") % WORDS_A_LINE
    side = F.col("row") % 2
    placed = w.withColumn("row", row).withColumn("j", j).select(
        "doc",
        F.floor(F.col("row") / LINES_A_PAGE).alias("page"),
        "n",
        "text",
        (F.when(F.col("doc") % 3 == 0, 40.0).otherwise(40.0 + side * 240.0) + F.col("j") * F.when((F.col("doc") % 3 > 0) & (side == 0), 35.0).otherwise(50.0)).alias("x0"),
        (F.floor((F.col("row") % LINES_A_PAGE) / 2) * 12.0 + ((F.col("n") * 7) % 3) * 1.5).alias("top"),
    )
    return placed.withColumn("x1", F.col("x0") + F.least(F.lit(30.0), F.length("text") * 4.0))


LINES = f"""{WORDS}, tops AS (SELECT DISTINCT doc, page, top FROM ws),
firsts AS (SELECT doc, page, min(top) AS top FROM tops GROUP BY doc, page UNION ALL SELECT doc, page, nxt FROM (SELECT f.doc, f.page, (SELECT min(t.top) FROM tops t WHERE t.doc = f.doc AND t.page = f.page AND t.top > f.top + 3.0) AS nxt FROM firsts f) WHERE nxt IS NOT NULL),
nums AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY top) - 1 AS line, lead(top) OVER (PARTITION BY doc, page ORDER BY top) AS below FROM firsts),
wl AS (SELECT ws.*, line FROM ws JOIN nums ON nums.doc = ws.doc AND nums.page = ws.page AND ws.top >= nums.top AND ws.top < coalesce(below, 1e9)),
g1 AS (SELECT *, CASE WHEN x0 - lag(x1) OVER o > 35.0 THEN 1 ELSE 0 END AS fresh FROM wl WINDOW o AS (PARTITION BY doc, page, line ORDER BY x0, top, n)),
g2 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, page, line ORDER BY x0, top, n ROWS UNBOUNDED PRECEDING) AS segment FROM g1),
lines AS (SELECT doc, page, line, segment, string_agg(text, ' ' ORDER BY x0, top, n) AS text, min(x0) AS x0, max(x1) AS x1, min(top) AS top FROM g2 GROUP BY doc, page, line, segment),
starts AS (SELECT doc, page, round(x0, 1) AS x, count(*) AS n, sum(x1 - x0) AS w FROM lines GROUP BY ALL),
sides AS (SELECT *, lead(x) OVER o AS nxt, sum(n) OVER l AS n0, sum(w) OVER l AS w0, sum(n) OVER p AS na, sum(w) OVER p AS wa FROM starts WINDOW o AS (PARTITION BY doc, page ORDER BY x), l AS (PARTITION BY doc, page ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY doc, page)),
splits AS (SELECT doc, page, (x + nxt) / 2 AS split FROM sides WHERE nxt - x >= 60 AND n0 >= 8 AND na - n0 >= 8 AND w0 / n0 < (wa - w0) / (na - n0) AND (x + nxt) / 2 > {WIDTH * 0.18} AND (x + nxt) / 2 < {WIDTH * 0.55} QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY nxt - x DESC, x) = 1)"""


@register(f"""WITH RECURSIVE {LINES}
SELECT l.doc, l.page, row_number() OVER (PARTITION BY l.doc, l.page ORDER BY CASE WHEN x0 >= split THEN 1 ELSE 0 END, line, segment) - 1 AS place, CASE WHEN x0 >= split THEN 1 ELSE 0 END AS "column", line, CAST(segment AS INTEGER) AS segment, text, x0, x1, top
FROM lines l LEFT JOIN splits s ON s.doc = l.doc AND s.page = l.page""")
def t30_lines_of_pages(spark, d):
    """Lines of all pages in the order in which they are read: down the left column, then down the right one."""
    page = ["doc", "page"]
    lines = pages.words_to_lines(_words(spark, d), page)
    ordered = pages.reading_order(pages.with_splits(lines, page, WIDTH), None, page)
    long = ("place", "line")
    return ordered.select(*page, *[F.col(c).cast("long").alias(c) for c in long], "column", "segment", "text", "x0", "x1", "top")
