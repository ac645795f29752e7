"""Queries of text functions, extraction and matching over the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import text as t
from ..operators import matching as match
from ..sources import views as v
from .sql_views import Register

register = Register()
W = r"\p{L}\p{N}_"
B = r"\s\x0B\p{Z}"
EMAIL = t.EMAIL
D = "coalesce(text, '')"


def _docs(spark, d):
    return v.table(spark, d, "documents")


def _lines(spark, d):
    """Each line of the documents with its place."""
    return _docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))


LINES = "lines_ AS (SELECT doc_id, i - 1 AS n, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))"


@register(f"SELECT doc_id, md5(replace(replace({D}, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def t1_line_breaks(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(t.line_breaks(F.col("text"))).alias("digest"))


TORN = D
for torn_, to_ in ((t.TORN_DASHES, "-"), (t.TORN_BULLETS, " ")):
    for x_ in torn_:
        TORN = f"replace({TORN}, '{x_}', '{to_}')" if x_ != t.TORN_DASHES[0] else f"replace(_x, '{x_}', '{to_}')"
WHOLE_WORDS = "x"
for torn_, to_ in t.TORN_WORDS.items():
    spaced_ = torn_.replace(" ", "\\s+")
    WHOLE_WORDS = f"regexp_replace({WHOLE_WORDS}, '(?i)\\b{spaced_}\\b', '{to_}', 'g')"
MAIL = t.FRAGMENTED


@register(rf"""
WITH a0 AS (SELECT doc_id, translate(regexp_replace(replace(replace({D}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\(cid:\d+\)', ' ', 'g'), '–—―•▪◦⁃∙·' || chr(160), '---       ') AS _x FROM documents),
a AS (SELECT doc_id, {TORN} AS x FROM a0),
b0 AS (SELECT doc_id, regexp_split_to_array(x, '{MAIL}') AS p, regexp_extract_all(x, '{MAIL}', 1) AS l, regexp_extract_all(x, '{MAIL}', 2) AS m, regexp_extract_all(x, '{MAIL}', 3) AS r FROM a),
b AS (SELECT doc_id, array_to_string(list_transform(p, lambda y, i: y || coalesce(l[i] || '@' || regexp_replace(m[i], '\s+', '', 'g') || '.' || r[i], '')), '') AS x FROM b0),
c AS (SELECT doc_id, regexp_replace(x, '(?i)\b([jfmasond])[ \t]+(anuary|ebruary|arch|pril|ay|une|uly|eptember|ctober|ovember|ecember)\b', '\1\2', 'g') AS x FROM b),
e AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\b([A-Z]{{3,}})[ \t]+([A-Z]{{1,2}})[ \t]+([A-Z]{{3,}})\b', '\1\2\3', 'g'), '\b([A-Z]{{4,}})[ \t]+([A-Z]{{2,3}})\b', '\1\2', 'g') AS x FROM c)
SELECT doc_id, md5(regexp_replace({WHOLE_WORDS}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')) AS digest FROM e""")
def t2_artifacts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(t.artifacts(F.col("text"))).alias("digest"))


@register(rf"SELECT doc_id, md5(regexp_replace(regexp_replace({D}, '(?i)https?://\S*?({EMAIL})\S*', ' \1 ', 'g'), '(?i)(?:https?://|www\.)\S+', ' ', 'g')) AS digest FROM documents")
def t3_without_urls(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(t.without_urls(F.col("text"))).alias("digest"))


@register(rf"SELECT doc_id, md5(regexp_replace({D}, '(?m)^[{B}]*[\-*\x{{2022}}\x{{25AA}}\x{{25E6}}\x{{2043}}\x{{2219}}]+[{B}]*', '', 'g')) AS digest FROM documents")
def t4_without_bullets(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(t.without_bullets(F.col("text"))).alias("digest"))


@register()
def t5_without_special_characters(spark, d):
    """Whole documents without marks that decorate; DuckDB cannot look around a run of marks."""
    return _docs(spark, d).select("doc_id", t.without_special_characters(F.col("text")).alias("cleaned"))


@register(rf"SELECT doc_id, md5(regexp_replace({D}, '(?i)\b({t.DATE})\b\s*(?:\?{{2,}}|\s+)\s*(present|current|now|{t.DATE})\b', '\1 - \2', 'g')) AS digest FROM documents")
def t6_repaired_date_ranges(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(t.repaired_date_ranges(F.col("text"))).alias("digest"))


@register(rf"""WITH a AS (SELECT doc_id, translate(replace(replace({D}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160) || chr(12) || chr(11), ' ' || chr(10) || chr(10)) AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(replace(x, chr(9), '    '), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}\x{{2060}}\x{{00AD}}]', '', 'g') AS x FROM a),
c AS (SELECT doc_id, replace(replace(regexp_replace(x, ' {{3,}}', chr(1), 'g'), '  ', ' '), chr(1), '  ') AS x FROM b),
e AS (SELECT doc_id, list_transform(string_split(x, chr(10)), lambda l: regexp_replace(l, '[{B}]+$', '')) AS l FROM c)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^[{B}]+|[{B}]+$', '', 'g')) AS digest FROM e""")
def t11_safe_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(t.safe_clean(F.col("text"))).alias("digest"))


@register(f"""WITH {LINES}, h AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13) || chr(160)) AS line FROM lines_),
o AS (SELECT *, CASE lower(rtrim(line, ' :')) WHEN 'summary' THEN 'summary' WHEN 'profile' THEN 'summary' WHEN 'objective' THEN 'summary' WHEN 'skills' THEN 'skills' WHEN 'technical skills' THEN 'skills'
  WHEN 'experience' THEN 'experience' WHEN 'work experience' THEN 'experience' WHEN 'education' THEN 'education' WHEN 'projects' THEN 'projects' WHEN 'certifications' THEN 'certifications' WHEN 'languages' THEN 'languages' END AS opens FROM h WHERE line <> ''),
s AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section FROM o)
SELECT doc_id, section, count(*) AS lines FROM s WHERE opens IS NULL GROUP BY doc_id, section""")
def t12_sections(spark, d):
    """Every fifth line names a section here, as the invented prose has no headers."""
    lines = _docs(spark, d).select("doc_id", F.explode(t.sections(F.col("text"), t.HEADERS)).alias("s")).select("doc_id", "s.*")
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.coalesce(F.last("opens", ignorenulls=True).over(w), F.lit("header")))
    return named.filter("opens is null").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"))


@register(rf"SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower({D}), '[a-z0-9][a-z0-9.+#/-]*') AS x FROM documents)")
def t15_tokens(spark, d):
    x = t.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, " ")).alias("digest"))


def _pairs(spark, d, clean_jobs=False):
    """Each document beside one benchmark passage, as a résumé beside a job text, which is cleaned once if that is asked for."""
    job = match.cleaned_text("text") if clean_jobs else F.col("text")
    items = v.table(spark, d, "benchmark").select(F.row_number().over(Window.orderBy("item_id")).alias("place"), job.alias("job"))  # a fixed list of passages
    n = items.agg(F.count(F.lit(1)).alias("n"))
    keyed = _docs(spark, d).select("doc_id", "text").crossJoin(F.broadcast(n)).withColumn("place", (F.col("doc_id") % F.col("n") + 1).cast("int"))  # one row
    return keyed.join(items, "place")


PAIRS = "pairs_ AS (SELECT d.doc_id, coalesce(left(d.text, 2000), '') AS text, coalesce(left(b.text, 2000), '') AS job FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) AS place, count(*) OVER () AS n FROM benchmark) b ON b.place = d.doc_id % b.n + 1)"
STOP = ", ".join(f"'{w}'" for w in match.STOP_WORDS)
BM25 = rf"""k AS (SELECT doc_id, 'a' AS s, unnest(regexp_extract_all(lower(job), '[a-z0-9][a-z0-9.+#/-]*')) AS w FROM pairs_ UNION ALL SELECT doc_id, 'b', unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.+#/-]*')) FROM pairs_),
c AS (SELECT doc_id, w, CAST(count(*) FILTER (s = 'a') AS DOUBLE) AS a, CAST(count(*) FILTER (s = 'b') AS DOUBLE) AS b FROM k GROUP BY doc_id, w),
bm AS (SELECT doc_id, round(round(100 * least(1, coalesce(sum(a * b * 2.5 / (b + 1.5)) / nullif(sum(a * a * 2.5 / (a + 1.5)), 0), 0)), 8), 2) AS bm25 FROM c GROUP BY doc_id)"""
TFIDF = rf"""g AS (SELECT doc_id, s, list_filter(regexp_extract_all(lower(x), '[{W}]{{2,}}'), lambda y: y NOT IN ({STOP})) AS l FROM (SELECT doc_id, 'a' AS s, text AS x FROM pairs_ UNION ALL SELECT doc_id, 'b', job FROM pairs_)),
u AS (SELECT doc_id, s, unnest(l) AS w FROM g UNION ALL SELECT doc_id, s, l[i] || ' ' || l[i + 1] FROM (SELECT doc_id, s, l, unnest(range(1, len(l))) AS i FROM g)),
n AS (SELECT doc_id, w, CAST(count(*) FILTER (s = 'a') AS DOUBLE) AS a, CAST(count(*) FILTER (s = 'b') AS DOUBLE) AS b FROM u GROUP BY doc_id, w),
ti AS (SELECT doc_id, round(round(100 * coalesce(sum(a * b) / nullif(sqrt(sum(a * a * f * f)) * sqrt(sum(b * b * f * f)), 0), 0), 8), 2) AS tfidf FROM (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 1 + ln(1.5) END AS f FROM n) GROUP BY doc_id)"""


@register(f"WITH {PAIRS}, {TFIDF} SELECT p.doc_id, coalesce(tfidf, 0) AS tfidf FROM pairs_ p LEFT JOIN ti ON ti.doc_id = p.doc_id")
def t16_tfidf(spark, d):
    return match.tfidf_similarity(_pairs(spark, d), "doc_id", "text", "job")


@register(f"WITH {PAIRS}, {BM25} SELECT p.doc_id, coalesce(bm25, 0) AS bm25 FROM pairs_ p LEFT JOIN bm ON bm.doc_id = p.doc_id")
def t17_bm25(spark, d):
    return match.bm25_similarity(_pairs(spark, d), "doc_id", "job", "text")


@register(f"""WITH {PAIRS}, {TFIDF}, {BM25} SELECT p.doc_id, coalesce(tfidf, 0) AS tfidf, coalesce(bm25, 0) AS bm25, round(coalesce(tfidf, 0) * 0.6 + coalesce(bm25, 0) * 0.4, 2) AS combined
FROM pairs_ p LEFT JOIN ti ON ti.doc_id = p.doc_id LEFT JOIN bm ON bm.doc_id = p.doc_id""")
def t18_match(spark, d):
    return match.match(_pairs(spark, d), "doc_id", "text", "job")


@register()
def t18_cleaned_match(spark, d):
    """The same with both texts cleaned first, as the matching rule has it."""
    return match.match(_pairs(spark, d, clean_jobs=True), "doc_id", "text", "job", clean=True, job_cleaned=True)


VOCABULARY = "SELECT lower(r_name) AS phrase, 'region' AS label FROM region UNION ALL SELECT lower(p_brand), 'brand' FROM part GROUP BY 1 UNION ALL SELECT unnest(['the', 'in the', 'of the', 'und die', 'de la', 'que', 'of']), 'words'"


@register(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower({D}), '[a-z0-9][a-z0-9.+#/-]*') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS position FROM w),
s AS (SELECT doc_id, position, n, array_to_string(w[position:position + n - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE position + n - 1 <= len(w)), vocab AS ({VOCABULARY}),
h AS (SELECT doc_id, position, n, label, row_number() OVER (PARTITION BY doc_id, position ORDER BY n DESC) AS r FROM s JOIN vocab USING (phrase)), b AS (SELECT * FROM h WHERE r = 1),
k AS (SELECT *, max(position + n) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)
SELECT doc_id, CAST(position AS INT) AS position, CAST(n AS INT) AS words, label FROM k WHERE reach IS NULL OR position >= reach""")
def t20_phrases(spark, d):
    words = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("the", "in the", "of the", "und die", "de la", "que", "of")])).alias("phrase"), F.lit("words").alias("label"))
    brands = v.table(spark, d, "part").select(F.lower("p_brand").alias("phrase"), F.lit("brand").alias("label")).distinct()
    regions = v.table(spark, d, "region").select(F.lower("r_name").alias("phrase"), F.lit("region").alias("label"))
    return match.phrases(_docs(spark, d), "doc_id", "text", words.union(brands).union(regions))


ALIASED = "CASE lower(trim(s)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in match.SKILL_ALIASES.items()) + " ELSE lower(trim(s)) END"


@register(f"SELECT id, list_transform(skills, lambda s: {ALIASED}) AS names FROM candidates")
def t23_skill_names(spark, d):
    return v.candidates(spark, d).select("id", F.transform("skills", match.skill_name).alias("names"))


@register(f"""WITH x AS (SELECT c.id, list_transform(coalesce(c.skills, []), lambda s: {ALIASED}) AS mine, from_json(j.skills_json, '["VARCHAR"]') AS wanted FROM candidates c JOIN jobs j ON j.id = c.job_id)
SELECT id, CASE WHEN len(mine) = 0 THEN '' ELSE array_to_string(list_filter(list_transform(wanted, lambda s: {ALIASED}), lambda y: list_contains(mine, y)), ',') END AS matched,
  CASE WHEN len(mine) = 0 THEN array_to_string(wanted, ',') ELSE array_to_string(list_filter(list_transform(wanted, lambda s: {ALIASED}), lambda y: NOT list_contains(mine, y)), ',') END AS missing,
  CASE WHEN len(mine) = 0 THEN 0.0 ELSE round(len(list_filter(list_transform(wanted, lambda s: {ALIASED}), lambda y: list_contains(mine, y))) * 100.0 / len(wanted), 1) END AS percentage FROM x""")
def t24_skills_match(spark, d):
    jobs = v.jobs(spark, d).select(F.col("id").alias("job_id"), F.from_json("skills_json", "array<string>").alias("wanted"))
    m = v.candidates(spark, d).join(jobs, "job_id").select("id", match.skills_match(F.col("skills"), F.col("wanted")).alias("m"))
    return m.select("id", F.array_join("m.matched", ",").alias("matched"), F.array_join("m.missing", ",").alias("missing"), "m.percentage")


@register(rf"""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower({D}), '{EMAIL.replace("A-Z", "")}')),
  lambda x: {{'p': NOT regexp_matches(x, '@(?:gmail|yahoo|outlook|hotmail|icloud|proton)\.'), 'n': length(x), 'x': x}})), lambda s: s.x), ' ') AS emails FROM documents""")
def t27_emails(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(t.emails(F.col("text")), " ").alias("emails"))


@register(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({D}, '\+?\d[\d ().-]{{7,}}\d'), lambda x: regexp_replace(x, '[^\d+]', '', 'g')),
  lambda x: length(replace(x, '+', '')) BETWEEN 10 AND 15))), ' ') AS phones FROM documents""")
def t28_phones(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(t.phones(F.col("text"))), " ").alias("phones"))


@register(rf"""WITH x AS (SELECT doc_id, regexp_replace({D}, '^[{B}]+|[{B}]+$', '', 'g') AS x FROM documents)
SELECT doc_id, length(x) >= 100 AND length(regexp_replace(x, '\P{{L}}', '', 'g')) >= 30 AND length(regexp_replace(x, '\P{{L}}', '', 'g')) * 1.0 / greatest(length(x), 1) >= 0.3 AS meaningful FROM x""")
def t32_meaningful_text(spark, d):
    return _docs(spark, d).select("doc_id", t.meaningful(F.col("text")).alias("meaningful"))


COUNTS = ", ".join(f"len(regexp_extract_all(lower({D}), '{p}')) AS n{i}" for i, p in enumerate(t.FIELDS.values()))
PICK = " ".join(f"WHEN n{i} = m THEN '{k}'" for i, k in enumerate(t.FIELDS))


@register(f"WITH x AS (SELECT doc_id, {COUNTS} FROM documents), y AS (SELECT *, greatest(n0, n1, n2, n3, n4, n5) AS m FROM x) SELECT doc_id, CASE WHEN m = 0 THEN 'general' {PICK} END AS resume_type FROM y")
def t33_resume_type(spark, d):
    return _docs(spark, d).select("doc_id", t.resume_type(F.col("text")).alias("resume_type"))


TIERS = " ".join(f"WHEN regexp_matches(t, '{x}') THEN CASE WHEN regexp_extract(t, '{x}', 2) <> '' THEN regexp_extract(t, '{x}', 1) || '-' || regexp_extract(t, '{x}', 2) || ' years' ELSE regexp_extract(t, '{x}', 1) || '+ years' END" for x in t.YEARS)


@register(rf"""WITH x AS (SELECT item_id, lower({D} || CASE item_id % 4 WHEN 0 THEN ' 3 - 5 years' WHEN 1 THEN ' 7+ yrs' WHEN 2 THEN ' fresher' ELSE '' END) AS t FROM benchmark)
SELECT item_id, CASE {TIERS} WHEN regexp_matches(t, 'entry\s*level|no\s*experience|fresh') THEN 'Entry level' ELSE '' END AS experience FROM x""")
def t46_job_experience(spark, d):
    more = F.element_at(F.array(*[F.lit(x) for x in (" 3 - 5 years", " 7+ yrs", " fresher", "")]), (F.col("item_id") % 4 + 1).cast("int"))
    return v.table(spark, d, "benchmark").select("item_id", t.job_experience(F.concat(F.coalesce("text", F.lit("")), more)).alias("experience"))


@register("SELECT id, '$' || (10000 + id) AS salary FROM jobs")
def t47_job_salary(spark, d):
    return v.jobs(spark, d).select("id", t.job_salary(F.col("salary_range")).alias("salary"))


@register("""SELECT id, CASE id % 5 WHEN 0 THEN 'Internship' WHEN 1 THEN 'Contract' WHEN 2 THEN 'Part-time' ELSE 'Full-time' END AS job_type FROM jobs""")
def t48_job_type(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Summer INTERN", "Contractor", "a part time role", "office", "")]), (F.col("id") % 5 + 1).cast("int"))
    return v.jobs(spark, d).select("id", t.job_type(said).alias("job_type"))


@register("SELECT id, CAST(10000 + id AS DOUBLE) AS low, CAST(20000 + 2 * id AS DOUBLE) AS high, 'YEAR' AS unit, 'USD' AS currency FROM jobs")
def t51_salary_range(spark, d):
    return v.jobs(spark, d).select("id", t.salary_range(F.col("salary_range")).alias("s")).select("id", "s.*")


@register("SELECT id, 'engineer-' || (id % 50) || CASE WHEN trim(coalesce(city, '')) = '' THEN '' ELSE '-' || lower(city) END || '-' || id AS slug FROM jobs")
def t52_job_slug(spark, d):
    return v.jobs(spark, d).select("id", t.job_slug(F.col("title"), F.col("city"), F.col("id")).alias("slug"))


@register("SELECT id, lower(uid) AS found FROM (SELECT id, md5(CAST(id AS VARCHAR)) AS m, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS uid FROM jobs)")
def t53_id_of_slug(spark, d):
    m = F.md5(F.col("id").cast("string"))
    uid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return v.jobs(spark, d).select("id", t.id_of_slug(F.concat(F.lit("some-job-"), F.upper(uid))).alias("found"))


@register("SELECT id, concat_ws(', ', nullif(trim(city), ''), state, country) AS place FROM jobs")
def t54_location(spark, d):
    return v.jobs(spark, d).select("id", t.location_of(F.col("city"), F.col("state"), F.col("country"), otherwise=F.lit("Remote")).alias("place"))


@register(r"SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'New York' WHEN c_custkey % 3 = 1 THEN NULL ELSE NULL END AS place FROM customer")
def t56_plain_location(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in (" New \t York ", "Sector 21", "one two three four five six")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), t.plain_location(said).alias("place"))


@register("SELECT id, 'Dear ' || name || ', your stage is ' || stage || '; ref ' || coalesce(CAST(job_id AS VARCHAR), '') AS message FROM candidates")
def t58_template(spark, d):
    text = F.lit("Dear {{name}}, your stage is {{stage}}; ref {{job}}")
    c = v.candidates(spark, d)
    return c.select("id", t.rendered(text, {"name": F.col("name"), "stage": F.col("stage"), "job": F.col("job_id")}).alias("message"))


@register(r"""SELECT conv_id, turn, CASE WHEN x = '' THEN 'Transcript: [' || turn || '] ' || role || ':' ELSE role || ': ' || x END AS said
FROM (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS x FROM conversations)""")
def t59_whole_turns(spark, d):
    """Each turn as a transcript of its own, parsed without a cut, so no conversation is gathered in a row."""
    head = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "))
    turns = v.table(spark, d, "conversations").select("conv_id", "turn", F.explode(t.transcript_segments(F.concat(head, t.escaped_turn(F.col("text"))))).alias("s"))
    return turns.select("conv_id", "turn", F.concat("s.speaker", F.lit(": "), t.plain_turn(F.col("s.message"))).alias("said"))


@register("SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents")
def t68_fingerprint(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))


SPOKEN = "CASE id % 6 WHEN 0 THEN ['Mar 49', '3/2001', 'Sept 2020'] WHEN 1 THEN ['1999', 'March 2050', '13/2001'] WHEN 2 THEN ['Dec 07', '07.15', 'x'] ELSE ['Jan 1998', '2030', ''] END"
WANTED = "CASE id % 6 WHEN 0 THEN NULL || ['-', '2001-03-01', '2020-09-01'] WHEN 1 THEN ['1999-01-01', '-', '-'] WHEN 2 THEN ['2007-12-01', '2015-07-01', '-'] ELSE ['1998-01-01', '-', '-'] END"


@register(f"SELECT id, array_to_string({WANTED.replace('NULL || ', '')}, ' ') AS months FROM jobs")
def d6_month_tokens(spark, d):
    said = {0: ("Mar 49", "3/2001", "Sept 2020"), 1: ("1999", "March 2050", "13/2001"), 2: ("Dec 07", "07.15", "x")}
    lists = F.lit(None)
    for k in range(6):
        lists = F.when(F.col("id") % 6 == k, F.array(*[F.lit(x) for x in said.get(k, ("Jan 1998", "2030", ""))])).otherwise(lists) if k else F.when(F.col("id") % 6 == 0, F.array(*[F.lit(x) for x in said[0]]))
    return v.jobs(spark, d).select("id", F.array_join(F.transform(lists, lambda x: F.coalesce(dt.month_date(x, 2028).cast("string"), F.lit("-"))), " ").alias("months"))


@register("SELECT id, (1990 + id % 30) || '-01-01' AS a, (1991 + id % 30) || '-12-31' AS b FROM jobs")
def d8_fiscal_span(spark, d):
    year = (F.col("id") % 30 + 1990).cast("string")
    span = dt.fiscal_span(F.concat(F.lit("FY"), year, F.lit("-"), F.lpad(((F.col("id") % 30 + 1991) % 100).cast("string"), 2, "0")))
    ok = F.when((F.col("id") % 30 + 1991) < 2000, span).otherwise(dt.fiscal_span(F.concat(year, F.lit("/"), (F.col("id") % 30 + 1991).cast("string"))))
    return v.jobs(spark, d).select("id", ok.alias("s")).select("id", F.col("s.start").cast("string").alias("a"), F.col("s.end").cast("string").alias("b"))


@register("""WITH x AS (SELECT id, CAST(created_at AS DATE) AS a, CAST(coalesce(updated_at, created_at) AS DATE) + CAST(id % 900 AS INT) AS b FROM candidates), y AS (SELECT id, CAST(greatest(1,
  (year(b) - year(a)) * 12 + month(b) - month(a) + CASE WHEN day(b) >= day(a) THEN 1 ELSE 0 END) AS INT) AS months FROM x)
SELECT id, months, concat_ws(' ', CASE WHEN months >= 12 THEN (months // 12) || ' year' || CASE WHEN months >= 24 THEN 's' ELSE '' END END, CASE WHEN months % 12 > 0 THEN (months % 12) || ' month' || CASE WHEN months % 12 > 1 THEN 's' ELSE '' END END) AS duration FROM y""")
def d13_months(spark, d):
    c = v.candidates(spark, d)
    end = F.date_add(F.to_date(F.coalesce("updated_at", "created_at")), (F.col("id") % 900).cast("int"))
    n = dt.months_inclusive(F.to_date("created_at"), end)
    return c.select("id", n.alias("months"), dt.duration_text(n).alias("duration"))


@register("""WITH x AS (SELECT id, CAST(created_at AS DATE) AS a, CAST(coalesce(updated_at, created_at) AS DATE) AS b FROM candidates)
SELECT id, a <= b AND a <= DATE '2001-08-01' AND date_trunc('month', b) <= DATE '2001-08-01' AS valid FROM x""")
def d12_valid_span(spark, d):
    end = F.to_date(F.coalesce("updated_at", "created_at"))
    return v.candidates(spark, d).select("id", dt.valid_span(F.to_date("created_at"), end, F.lit("2001-08-01").cast("date")).alias("valid"))


@register("""WITH x AS (SELECT candidate_id % 500 AS k, CAST(created_at AS DATE) AS a, CAST(created_at AS DATE) + CAST(20 AS INT) AS b FROM interviews),
y AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
z AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM y),
i AS (SELECT k, max(b) - min(a) + 1 AS days FROM z GROUP BY k, g), t AS (SELECT k, round(sum(days) / 365.25, 1) AS years FROM i GROUP BY k)
SELECT k, years, CASE WHEN years <= 2 THEN 'Junior' WHEN years <= 5 THEN 'Mid-level' WHEN years <= 10 THEN 'Senior' ELSE 'Lead/Expert' END AS level FROM t""")
def d15_total_experience(spark, d):
    from ..operators.windows import merge_intervals

    x = v.interviews(spark, d).select((F.col("candidate_id") % 500).alias("k"), F.to_date("created_at").alias("a"))
    islands = merge_intervals(x.withColumn("b", F.date_add("a", 20)), "k", "a", "b")
    years = islands.groupBy("k").agg(F.round(F.sum(F.datediff("b", "a") + 1) / 365.25, 1).alias("years"))
    return years.withColumn("level", dt.experience_level(F.col("years")))


@register("SELECT id, created_at + to_days(CAST(greatest(floor(epoch(TIMESTAMP '2001-08-01 06:30:00' - created_at) / 2592000), 0) * 30 AS INT)) AS start FROM users")
def d24_cycle_start(spark, d):
    return v.users(spark, d).select("id", dt.cycle_start(F.col("created_at"), F.lit(v.AS_OF).cast("timestamp"), 30).alias("start"))
