"""Queries of totals, summaries, job texts, payloads, queues and the accuracy of extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import history as h
from ..functions import resume as r
from ..functions import scoring as sc
from ..functions import sections as s
from ..functions import text as t
from ..operators import matching as match
from ..sources import feeds
from ..sources import resumes as made
from ..sources import views as v
from ..sources.shared import shared_folder
from .resumes import LABELLED, SECTIONS, THIS_YEAR
from .sql_views import Register

register = Register()
B = r"\s\x0B\p{Z}"


def _sections(spark, d, *names):
    found = made.resumes(spark, d).select("id", F.explode(s.segmented(F.col("text"), names)).alias("s"))
    return found.select("id", "s.*")


@register()
def m9_balanced_total(spark, d):
    """All parts over whole résumés; the sum, its label and status."""
    wanted = F.array(F.lit("Python"), F.lit("SQL"), F.lit("docker"))
    text = F.col("text")
    years = h.years_from_section(text, s.content_of(text, "experience"), THIS_YEAR)
    rows = made.resumes(spark, d).select("id", "text", years.alias("years"), r.title_bonus(F.col("text"), F.lit("Senior Engineer")).alias("bonus"))
    total = sc.balanced_total(F.col("text"), F.col("years"), F.lit(2), F.lit(6), wanted, F.lit("Backend Engineer"), F.col("bonus"))
    return rows.select("id", total.alias("t")).select("id", "t.*")


KEYS, STOPS = "responsibilities|duties|tasks|you will|what you'll do", "requirements|qualifications|skills|benefits|experience"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{B}]+|[{B}]+$', '', 'g')"




@register(rf"""WITH l AS (SELECT id, string_split(text, chr(10)) AS l FROM resumes), o AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM l),
c AS (SELECT id, i, {_strip("CASE WHEN contains(l[i], ':') THEN regexp_extract(l[i], '^[^:]*:(.*)$', 1) ELSE '' END")} AS head, list_filter(list_transform(l[i + 1:i + 19], lambda x: {_strip('x')}), lambda x: x <> '') AS rest
  FROM o WHERE (contains(l[i], ':') AND regexp_matches(lower(l[i]), '{KEYS.replace("'", "''")}')) OR regexp_matches(lower({_strip('l[i]')}), '^({KEYS.replace("'", "''")})')),
s AS (SELECT *, list_position(list_transform(rest, lambda x: regexp_matches(lower(x), '{STOPS}')), true) AS stop FROM c),
b AS (SELECT id, i, trim(left(array_to_string(list_filter([head], lambda x: x <> '') || CASE WHEN stop > 0 THEN rest[1:stop - 1] ELSE rest END, ' '), 800), ' ') AS told FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM b WHERE told <> '')
SELECT resumes.id, md5(coalesce(told, '')) AS digest FROM resumes LEFT JOIN r ON r.id = resumes.id AND n = 1""")
def t50_responsibilities(spark, d):
    told = r.told_section(F.col("text"), KEYS, STOPS, 20)
    return made.resumes(spark, d).select("id", F.md5(told).alias("digest"))


@register(rf"""WITH {SECTIONS}, p AS (SELECT id, string_split(content, chr(10) || chr(10)) AS b FROM sections_ WHERE section = 'projects' AND content <> ''),
q AS (SELECT id, i - 1 AS k, b[i] AS block FROM (SELECT id, b, unnest(range(1, least(len(b), 8) + 1)) AS i FROM p)),
l AS (SELECT id, k, block, list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x, ' -*' || chr(9))), lambda x: x <> '') AS l FROM q)
SELECT id, k, left(l[1], 120) AS title, md5(left(CASE WHEN len(l) > 1 THEN array_to_string(l[2:], ' ') ELSE block END, 500)) AS digest FROM l""")
def t39_projects(spark, d):
    e = _sections(spark, d, "projects").select("id", F.posexplode(r.projects(F.col("content"))).alias("k", "e"))
    return e.select("id", F.col("k").cast("long").alias("k"), "e.title", F.md5("e.description").alias("digest"))


WORDS = ("python", "sql", "docker", "team", "data", "rest api", "machine learning")


@register(rf"""WITH {SECTIONS}, s1 AS (SELECT id, unnest(regexp_split_to_array(content, '[.!?\n]')) AS x FROM sections_ WHERE section = 'experience'),
a AS (SELECT id, string_agg(DISTINCT lower(x), '. ') AS x FROM s1 WHERE regexp_matches(x, '(?i)\b(worked on|built|developed|implemented|used|deploy|designed|experience with|services?|apis?|led)\b') GROUP BY id),
k AS (SELECT id, lower(content) AS x FROM sections_ WHERE section = 'skills' UNION ALL SELECT id, x FROM a)
SELECT id, w AS skill FROM (SELECT DISTINCT id, unnest(regexp_extract_all(x, '[a-z0-9][a-z0-9.+#/-]*')) AS w FROM k) WHERE w IN ('python', 'sql', 'docker', 'team', 'data')
UNION SELECT id, w FROM k, (SELECT unnest(['rest api', 'machine learning']) AS w) WHERE contains(' ' || array_to_string(regexp_extract_all(x, '[a-z0-9][a-z0-9.+#/-]*'), ' ') || ' ', ' ' || w || ' ')""")
def t36_contextual_skills(spark, d):
    """Skills of the skills section, and of sentences of work history that tell of something done."""
    done = r"(?i)\b(?:worked on|built|developed|implemented|used|deploy|designed|experience with|services?|apis?|led)\b"
    history = F.filter(F.split("content", r"[.!?\n]"), lambda x: x.rlike(done))
    told = F.when(F.col("section") == "skills", F.col("content")).otherwise(F.array_join(history, ". "))
    keyed = _sections(spark, d, "skills", "experience").select("id", F.col("section").alias("part"), told.alias("content")).select(F.struct("id", "part").alias("key"), "content")
    vocabulary = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in WORDS])).alias("phrase")).withColumn("label", F.col("phrase"))
    return match.phrases(keyed, "key", "content", vocabulary, 2).select("key.id", F.col("label").alias("skill")).distinct()


@register("""SELECT id, name, job, mail FROM (SELECT id, 'Cand ' || (id % 5000) AS name, coalesce(CAST(job_id AS VARCHAR), '') AS job, CASE WHEN id % 2 = 0 THEN email ELSE '' END AS mail FROM candidates)""")
def c9_payloads(spark, d):
    """Payloads whose keys are written in either style, read by the one name."""
    snake = F.to_json(F.struct(F.col("name").alias("candidate_name"), F.col("email").alias("candidate_email"), F.col("job_id").cast("string").alias("job_id")))
    camel = F.to_json(F.struct(F.col("name").alias("candidateName"), F.col("job_id").cast("string").alias("jobId")))
    payload = F.when(F.col("id") % 2 == 0, snake).otherwise(camel)
    c = v.candidates(spark, d).select("id", payload.alias("p"))
    return c.select("id", *[ar.of_payload(F.col("p"), k).alias(n) for n, k in (("name", "candidate_name"), ("job", "job_id"), ("mail", "candidate_email"))])


@register("SELECT id, array_to_string(list_sort(list_distinct(list_transform(coalesce(skills, []), lambda x: lower(trim(x))))), ',') AS skills, lower(coalesce(source, '')) AS sources FROM candidates")
def c3_list_fields(spark, d):
    """Every list field without repeats."""
    c = v.candidates(spark, d).select("id", F.concat(F.coalesce("skills", F.array().cast("array<string>")), F.coalesce("skills", F.array().cast("array<string>"))).alias("skills"), F.array(F.col("source"), F.upper("source")).alias("sources"))
    clean = ar.distinct_lists(c, "skills", "sources")
    return clean.select("id", *[F.array_join(F.array_sort(F.transform(x, F.lower)), ",").alias(x) for x in ("skills", "sources")])


@register("SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def l9_locale_order(spark, d):
    """Names in the order of a Unicode collation; 25 rows."""
    by = W.orderBy(F.collate(F.initcap("n_name"), "UNICODE"))
    return v.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.row_number().over(by).cast("long").alias("place"))


@register("SELECT id, 'Dear ' || name || ', you are now ' || stage AS message, 'queued' AS status FROM candidates WHERE stage IN ('SHORTLISTED', 'REJECTED', 'SELECTED')")
def o8_notifications(spark, d):
    """Messages rendered and appended to the queue's table; nothing is sent."""
    c = v.candidates(spark, d).filter(F.col("stage").isin("SHORTLISTED", "REJECTED", "SELECTED"))
    queue = c.select("id", t.rendered(F.lit("Dear {{name}}, you are now {{stage}}"), {"name": F.col("name"), "stage": F.col("stage")}).alias("message"), F.lit("queued").alias("status"))
    path = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    feeds.append(queue, path)
    return spark.read.schema(queue.schema).parquet(path)


@register("SELECT c.id, coalesce(j.title, 'General Position') AS title, coalesce(j.skills_json, '[]') AS skills FROM candidates c LEFT JOIN jobs j ON j.id = c.job_id")
def q3_stored_candidates(spark, d):
    """Stored candidates with the job that they are scored against; a general one where there is none."""
    jobs = v.jobs(spark, d).select(F.col("id").alias("job_id"), "title", "skills_json")
    both = v.candidates(spark, d).join(jobs, "job_id", "left")
    return both.select("id", F.coalesce("title", F.lit("General Position")).alias("title"), F.coalesce("skills_json", F.lit("[]")).alias("skills"))


@register("""SELECT i.id, c.name, strftime(i.scheduled_at, '%Y-%m-%d %H:%M') AS at FROM interviews i JOIN candidates c ON c.id = i.candidate_id
WHERE i.status = 'scheduled' AND CAST(i.scheduled_at AS DATE) BETWEEN DATE '1998-08-01' AND DATE '1998-08-08' AND (trim(coalesce(i.meeting_link, '')) <> '' OR i.async_link IS NOT NULL) ORDER BY i.scheduled_at, i.id LIMIT 10""")
def p21_upcoming_with_details(spark, d):
    """The next ten interviews of a week that have a link; a list that is cut on purpose."""
    day = F.to_date("scheduled_at")
    own = v.interviews(spark, d).filter((F.col("status") == "scheduled") & day.between(F.lit("1998-08-01").cast("date"), F.lit("1998-08-08").cast("date")))
    own = own.filter((F.trim(F.coalesce("meeting_link", F.lit(""))) != "") | F.col("async_link").isNotNull()).orderBy("scheduled_at", "id").limit(10)
    names = v.candidates(spark, d).select(F.col("id").alias("candidate_id"), "name")
    return own.join(names, "candidate_id").select("id", "name", F.date_format("scheduled_at", "yyyy-MM-dd HH:mm").alias("at"))


EXPECTED = "[" + ", ".join(f"'{c}'" for c in made.COMPANIES) + f"][id % {len(made.COMPANIES)} + 1]"


def _accuracy(spark, d):
    """(id, company, mail, precision, recall): what extraction finds in each résumé that names an employer, against what was put in."""
    rows = made.resumes(spark, d).select("id", "text", F.explode(s.segmented(F.col("text"), ("experience",))).alias("s")).select("id", "text", "s.*")
    e = rows.select("id", "text", h.labelled_entries(F.col("content"), THIS_YEAR).alias("e")).filter(F.size("e") > 0)
    company = F.element_at(F.array(*[F.lit(x) for x in made.COMPANIES]), (F.col("id") % len(made.COMPANIES) + 1).cast("int"))
    mail = F.concat(F.lit("asha"), F.col("id").cast("string"), F.lit("@mail.example"))
    return e.select("id", (F.get("e", F.lit(0))["company"] == company).alias("company"), F.array_contains(t.emails(F.col("text")), mail).alias("mail"))


@register(f"""WITH {LABELLED}, f AS (SELECT id, arg_min(company, b) = {EXPECTED} AS company FROM labelled_ GROUP BY id)
SELECT field, count(*) AS cases, round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM (SELECT 'company' AS field, company AS good FROM f UNION ALL SELECT 'mail', contains(lower(text), 'asha' || f.id || '@mail.example') FROM f JOIN resumes ON resumes.id = f.id) GROUP BY field""")
def a35_extraction_accuracy(spark, d):
    """The share of résumés of which a field is found as it was put in, by field."""
    fields = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("good")) for x in ("company", "mail")]))
    rows = _accuracy(spark, d).select(fields.alias("f")).select("f.*")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("good").cast("int")), 4).alias("accuracy"))


def _letters(c: str) -> str:
    return rf"length(regexp_replace({c}, '\P{{L}}', '', 'g')) * 1.0 / greatest(length({c}), 1)"


BARE = rf"regexp_replace(coalesce(text, ''), '(?m)^[{B}]*[\-*\x{{2022}}\x{{25AA}}\x{{25E6}}\x{{2043}}\x{{2219}}]+[{B}]*', '', 'g')"


@register(f"""WITH x AS (SELECT coalesce(lang, 'none') AS lang, {_letters("coalesce(text, '')")} AS a, {_letters(BARE)} AS b FROM documents)
SELECT lang, round(avg(a), 4) AS before, round(avg(b), 4) AS after, round(round(avg(b), 4) - round(avg(a), 4), 4) AS gain, round((round(avg(b), 4) - round(avg(a), 4)) / nullif(round(avg(a), 4), 0), 4) AS relative FROM x GROUP BY lang""")
def a36_cleaning_gain(spark, d):
    """The mean share of letters before and after bullets are taken away, the gain, and the gain in relation, by language."""
    share = lambda c: F.regexp_count(c, F.lit(r"\p{L}")) / F.greatest(F.length(c), F.lit(1))
    text = F.coalesce("text", F.lit(""))
    x = v.table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), share(text).alias("a"), share(t.without_bullets(text)).alias("b"))
    both = x.groupBy("lang").agg(F.round(F.avg("a"), 4).alias("before"), F.round(F.avg("b"), 4).alias("after"))
    gain = F.round(F.col("after") - F.col("before"), 4)
    return both.select("lang", "before", "after", gain.alias("gain"), F.round(F.try_divide(F.col("after") - F.col("before"), F.col("before")), 4).alias("relative"))


@register(f"""WITH {LABELLED}, f AS (SELECT id, arg_min(company, b) = {EXPECTED} AS company FROM labelled_ GROUP BY id),
a AS (SELECT 'company' AS item, round(avg(CASE WHEN company THEN 1.0 ELSE 0.0 END), 4) AS value FROM f UNION ALL SELECT 'labelled entries', round(count(*) * 1.0 / (SELECT count(*) FROM resumes), 4) FROM f)
SELECT item, value, CASE WHEN value >= 0.9 THEN 'OK' ELSE 'NEEDS WORK' END AS label FROM a""")
def a38_readiness(spark, d):
    """Two reports together, with a label: at least nine in ten is OK."""
    a = _accuracy(spark, d)
    one = a.agg(F.lit("company").alias("item"), F.round(F.avg(F.col("company").cast("int")), 4).alias("value"))
    n = made.resumes(spark, d).agg(F.count(F.lit(1)).alias("n"))
    two = a.agg(F.count(F.lit(1)).alias("m")).crossJoin(n).select(F.lit("labelled entries").alias("item"), F.round(F.col("m") / F.col("n"), 4).alias("value"))  # one row each
    return one.unionByName(two).withColumn("label", F.when(F.col("value") >= 0.9, "OK").otherwise("NEEDS WORK"))
