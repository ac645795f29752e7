"""Queries of résumé sections, work history and field checks over résumés made of all documents' whole texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks as k
from ..functions import history as h
from ..functions import sections as s
from ..functions.arrays import let
from ..operators import experience as x
from ..operators import work_history as wh
from ..sources import resumes as made
from ..sources import views as v
from ..sources.resumes import resumes
from .sql_views import Register

register = Register()
B = r"\s\x0B\p{Z}"
THIS_YEAR = 2030


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{B}]+|[{B}]+$', '', 'g')"


def _plain(c: str) -> str:
    return _strip(f"regexp_replace(translate({c}, '–—―•▪◦·' || chr(160) || chr(13), '---     '), '[ \\t]+', ' ', 'g')")


def _words(c: str) -> str:
    bare = rf"regexp_replace({c}, '^[\s|_\-=~*#.:]+|[\s|_\-=~*#.:]+$', '', 'g')"
    return rf"lower(regexp_replace(regexp_replace(regexp_replace({bare}, '[^A-Za-z\s-]', ' ', 'g'), '[ \t]+', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g'))"


def _section(w: str) -> str:
    """The section of header words: names, then terms, then what they begin with."""
    named = [f"WHEN regexp_full_match({w}, '{p}') THEN '{n}'" for group in (s.NAMES, s.TERMS) for n, p in group.items()]
    begun = [f"WHEN regexp_matches({w}, '^(?:{p})\\b') THEN '{n}'" for n, p in s.TERMS.items()]
    return f"CASE WHEN {w} = '' THEN NULL {' '.join(named + begun)} END"


INLINE = r"^([^:]{1,60}?):\s*(.+)$"
REST = " ".join(rf"WHEN '{n}' THEN regexp_extract(line, '(?i)^(?:{p})\b[ :\-|]*(.*?)[ :\-|]*$', 1)" for n, p in s.TERMS.items())
SECTIONS = rf"""l_ AS (SELECT id, i - 1 AS n, {_plain('x[i]')} AS line FROM (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS x FROM resumes))),
w_ AS (SELECT *, {_words('line')} AS w, {_words(f"regexp_extract(line, '{INLINE}', 1)")} AS hw FROM l_),
c_ AS (SELECT *, CASE WHEN regexp_matches(line, '{INLINE}') THEN {_section('hw')} END AS inl, CASE WHEN len(regexp_split_to_array(w, '\s+')) <= 6 THEN {_section('w')} END AS who,
  w <> '' AND len(regexp_split_to_array(w, '\s+')) <= 6 AND regexp_full_match(w, '{s.BOUNDARIES}') AS bound FROM w_),
o_ AS (SELECT *, CASE WHEN inl IS NOT NULL THEN inl WHEN who IS NOT NULL THEN who WHEN bound THEN '-' END AS opens, coalesce(inl = 'languages', false) AS tongue FROM c_),
p_ AS (SELECT *, CASE WHEN opens IS NOT NULL AND NOT (tongue AND coalesce(last_value(CASE WHEN NOT tongue THEN opens END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'skills') THEN opens END AS really FROM o_),
q_ AS (SELECT *, last_value(really IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM p_),
r_ AS (SELECT *, CASE WHEN inl IS NOT NULL THEN trim(regexp_extract(line, '{INLINE}', 2)) ELSE CASE who {REST} END END AS told FROM q_ WHERE really IS NOT NULL AND really <> '-'),
t_ AS (SELECT id, n, really AS section, told AS line FROM r_ WHERE told <> '' AND (inl IS NOT NULL OR {_section(_words('told'))} IS NULL)
  UNION ALL SELECT id, n, CASE WHEN now = 'summary' AND n < 12 AND regexp_matches(line, '(?i)^(?:{s.CONTACT})\b') THEN 'header' ELSE now END, line FROM q_ WHERE really IS NULL AND now IS NOT NULL AND now <> '-'
  UNION ALL SELECT id, n, 'header', line FROM q_ WHERE now IS NULL AND n < 12 AND line <> ''),
u_ AS (SELECT *, row_number() OVER (PARTITION BY id, section ORDER BY n) AS r FROM t_),
sections_ AS (SELECT id, section, {_strip(r"regexp_replace(string_agg(regexp_replace(line, '^\s*[-*•▪◦·]+\s*', ''), chr(10) ORDER BY n), '\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM u_ WHERE section <> 'header' OR r <= 10 GROUP BY id, section)"""


def _sections(spark, d, wanted=s.SECTIONS):
    return resumes(spark, d).select("id", F.explode(s.segmented(F.col("text"), wanted)).alias("s")).select("id", "s.*")


def _experience(spark, d):
    return _sections(spark, d, ("experience",)).select("id", "content")


@register(f"WITH {SECTIONS} SELECT id, section, md5(content) AS digest FROM sections_ WHERE content <> ''")
def t12_segmented(spark, d):
    return _sections(spark, d).select("id", "section", F.md5("content").alias("digest"))


@register(f"WITH {SECTIONS} SELECT id, n, coalesce({_section('w')}, '') AS section FROM w_ WHERE w <> ''")
def t13_section_names(spark, d):
    lines = resumes(spark, d).select("id", F.posexplode(F.transform(F.split("text", "\r\n|\r|\n"), s.plain_line)).alias("n", "line"))
    named = lines.select("id", F.col("n").cast("long").alias("n"), s.header_words(F.col("line")).alias("w")).filter("w <> ''")
    return named.select("id", "n", F.coalesce(s.section_of(F.col("w")), F.lit("")).alias("section"))


RANGE = rf"(?i)\b({h.t.DATE})\s*(?:-|–|to)\s*({h.t.DATE}|present|current|now|till date)\b"


def _month(c: str) -> str:
    """The date of ``Mon YYYY``, ``m/yyyy`` or ``YYYY``."""
    low = f"lower({c})"
    names = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    month = rf"CASE WHEN regexp_matches({low}, '^[a-z]') THEN list_position({names}, {low}[1:3]) WHEN regexp_matches({low}, '^\d{{1,2}}[/-]') THEN CAST(regexp_extract({low}, '^(\d+)', 1) AS INT) ELSE 1 END"
    year = rf"CAST(nullif(regexp_extract({low}, '(\d{{4}})$', 1), '') AS INT)"
    return f"CASE WHEN {year} BETWEEN 1950 AND {THIS_YEAR} AND {month} BETWEEN 1 AND 12 THEN make_date({year}, {month}, 1) END"


def _first_range(c: str) -> tuple[str, str, str]:
    """SQL of start, end and whether it runs, of the first good range of a text whose ranges are all good or none."""
    a, b = f"regexp_extract({c}, '{RANGE}', 1)", f"regexp_extract({c}, '{RANGE}', 2)"
    runs = f"regexp_matches({b}, '(?i)^(present|current|now|till date)$')"
    return _month(a), f"CASE WHEN NOT {runs} THEN {_month(b)} END", runs


START, END, RUNS = _first_range("line")
EXPERIENCE = rf"""{SECTIONS},
e_ AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS n, line FROM (SELECT id, i, regexp_replace({_plain('y[i]')}, '^[ |\-]+|[ |\-]+$', '', 'g') AS line FROM (SELECT id, y, unnest(range(1, len(y) + 1)) AS i FROM (SELECT id, string_split(content, chr(10)) AS y FROM sections_ WHERE section = 'experience'))) WHERE line <> '')"""
LABELLED = rf"""{EXPERIENCE},
f_ AS (SELECT *, count(*) FILTER (regexp_matches(line, '(?i)^organization\s*:\s*.+$')) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS b, regexp_matches(line, '(?i)^organization\s*:\s*.+$') AS org FROM e_),
g_ AS (SELECT *, count(*) FILTER (NOT org AND regexp_full_match(line, '(?i)(?:{h.ENDINGS})')) OVER (PARTITION BY id, b ORDER BY n ROWS UNBOUNDED PRECEDING) AS ended FROM f_ WHERE b > 0),
i_ AS (SELECT *, regexp_matches(line, '(?i)^designation\s*:\s*.+$') AS des, {START} AS a, {END} AS z, {RUNS} AS runs FROM g_ WHERE ended = 0),
j_ AS (SELECT *, NOT org AND NOT des AND a IS NOT NULL AND (runs OR z >= a) AS dated FROM i_),
m_ AS (SELECT id, b, regexp_extract(max(line) FILTER (org), '(?i)^organization\s*:\s*(.+)$', 1) AS company, regexp_extract(arg_max(line, n) FILTER (des), '(?i)^designation\s*:\s*(.+)$', 1) AS role, min(n) FILTER (dated) AS p FROM j_ GROUP BY id, b HAVING min(n) FILTER (dated) IS NOT NULL),
labelled_ AS (SELECT m_.id, m_.b, m_.company, m_.role, j_.a AS start, j_.z AS "end", j_.runs AS is_current FROM m_ JOIN j_ ON j_.id = m_.id AND j_.n = m_.p)"""


def _entries(spark, d, which):
    return _experience(spark, d).select("id", F.posexplode(which(F.col("content"), THIS_YEAR)).alias("k", "e"))


def _listed(spark, d, which):
    return _experience(spark, d).select("id", F.posexplode(which(F.col("content"), F.lit(f"{THIS_YEAR}-01-01").cast("date"))).alias("k", "e"))


@register(f"""WITH {LABELLED} SELECT id, row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS k, company, role, strftime(start, '%Y-%m') AS a, strftime("end", '%Y-%m') AS b, is_current FROM labelled_""")
def e1_labelled_entries(spark, d):
    month = lambda c: F.date_format(c, "yyyy-MM")
    return _entries(spark, d, h.labelled_entries).select("id", F.col("k").cast("long").alias("k"), "e.company", "e.role", month("e.start").alias("a"), month("e.end").alias("b"), "e.is_current")


WHOLE = rf"(?i)((?:[A-Z][A-Za-z0-9()/&.\-]*\s+){{0,6}}(?:{h.TITLES})(?:\s+[A-Z0-9][A-Za-z0-9()/&.\-]*){{0,3}})\s+\|\s+((?:{h.t.DATE})\s*(?:-|–|to|until|through)\s*(?:present|current|now|(?:{h.t.DATE})))\s+(.+)$"
A2, Z2, R2 = _first_range(f"regexp_replace(regexp_extract(line, '{WHOLE}', 2), '(?i)\\b(?:until|through)\\b', 'to')")
INLINED = rf"""{EXPERIENCE},
n_ AS (SELECT id, n, regexp_extract(line, '{WHOLE}', 1) AS role, regexp_replace(regexp_replace(regexp_extract(line, '{WHOLE}', 3), '(?i)\b(?:{h.VERBS})\b.*$', ''), '^[ |\-,:]+|[ |\-,:]+$', '', 'g') AS company, {A2} AS a, {Z2} AS z, {R2} AS runs FROM e_ WHERE regexp_matches(line, '{WHOLE}')),
inlined_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS k FROM n_ WHERE company <> '' AND a IS NOT NULL AND (runs OR z >= a) AND (company NOT LIKE '%,%' OR regexp_matches(company, '(?i)\b(?:{h.COMPANY_NOISE})\b')))"""


@register(f"WITH {INLINED} SELECT id, k, company, role, strftime(a, '%Y-%m') AS a, runs AS is_current FROM inlined_")
def e4_inline_entries(spark, d):
    e = _listed(spark, d, h.inline_entries)
    return e.select("id", F.col("k").cast("long").alias("k"), "e.company", "e.role", F.date_format("e.start", "yyyy-MM").alias("a"), "e.is_current")


@register(rf"""WITH {SECTIONS},
e_ AS (SELECT id, i AS n, regexp_replace({_plain('y[i]')}, '^[ |\-]+|[ |\-]+$', '', 'g') AS line FROM (SELECT id, y, unnest(range(1, len(y) + 1)) AS i FROM (SELECT id, string_split(content, chr(10)) AS y FROM sections_ WHERE section = 'experience'))),
a_ AS (SELECT *, {START} IS NOT NULL AND ({RUNS} OR {END} >= {START}) AS dated, regexp_matches(line, '(?i)^organization\s*:\s*.+$') AS org,
  line <> '' AND len(string_split(line, ' ')) <= 12 AND line NOT LIKE '%.' AND regexp_matches(line, '(?i)\b(?:{h.ROLES})\b') AS heading FROM e_),
b_ AS (SELECT *, first_value(CASE WHEN line <> '' THEN dated END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_dated FROM a_),
d_ AS (SELECT *, CASE WHEN dated AND NOT (line = '') THEN 'dated' WHEN line = '' OR org OR (heading AND coalesce(next_dated, false)) THEN 'reset' END AS event FROM b_),
f_ AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM d_),
g_ AS (SELECT *, count(*) FILTER (line = '' OR (NOT dated AND heading AND coalesce(next_dated, false)) OR ((dated OR org) AND coalesce(was, '') = 'dated')) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM f_)
SELECT id, block, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM g_ WHERE line <> '' GROUP BY id, block HAVING bool_or(dated)""")
def e2_blocks(spark, d):
    blocks = x.blocks(_experience(spark, d), "id", "content", THIS_YEAR)
    return blocks.select("id", "block", F.size("lines").cast("long").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@register(f"""WITH {LABELLED},
kk AS (SELECT *, lower(trim(regexp_replace(company, '(?i)\\b(?:{h.COMPANY_NOISE})\\b', '', 'g'))) AS key, coalesce("end", DATE '2030-01-01') AS z FROM labelled_),
nn AS (SELECT *, row_number() OVER (PARTITION BY id, role, start, z ORDER BY is_current DESC, length(company) DESC, b) AS r FROM kk),
oo AS (SELECT *, row_number() OVER (PARTITION BY id, key, start, z ORDER BY len(string_split(coalesce(role, ''), ' ')) DESC, b) AS q FROM nn WHERE r = 1)
SELECT id, company, role, strftime(start, '%Y-%m') AS a, row_number() OVER (PARTITION BY id ORDER BY is_current DESC, z DESC, start DESC, b) AS place FROM oo WHERE q = 1""")
def c4_distinct_entries(spark, d):
    e = _entries(spark, d, h.labelled_entries).select("id", "k", "e.*")
    kept = x.distinct_entries(e, "id", "k")
    by = W.partitionBy("id").orderBy(F.col("is_current").desc(), F.coalesce("end", F.lit("2030-01-01").cast("date")).desc(), F.col("start").desc(), "k")
    return kept.select("id", "company", "role", F.date_format("start", "yyyy-MM").alias("a"), F.row_number().over(by).cast("long").alias("place"))


@register(f"""WITH {LABELLED}, y_ AS (SELECT id, year(start) AS a, CASE WHEN is_current THEN {THIS_YEAR} ELSE year("end") END AS b FROM labelled_),
m1 AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y_ WHERE b >= a),
m2 AS (SELECT *, count(*) FILTER (reach IS NULL OR a > reach + 1) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m1),
m3 AS (SELECT id, max(b) - min(a) AS years FROM m2 GROUP BY id, g)
SELECT s1.id, CAST(coalesce(sum(m3.years), 0) AS DOUBLE) AS years FROM (SELECT id FROM sections_ WHERE section = 'experience' AND content <> '') s1 LEFT JOIN m3 ON m3.id = s1.id GROUP BY s1.id""")
def d17_years_of_entries(spark, d):
    return _experience(spark, d).select("id", h.years_of_entries(h.labelled_entries(F.col("content"), THIS_YEAR), THIS_YEAR).alias("years"))


@register(f"""WITH {SECTIONS}, y_ AS (SELECT id, unnest(regexp_extract_all(content, '(\\d{{4}})\\s*[-–]\\s*(?:\\d{{4}}|(?i:present|current))', 0)) AS x FROM sections_ WHERE section = 'experience'),
y2 AS (SELECT id, CAST(x[1:4] AS INT) AS a, CASE WHEN regexp_matches(x, '\\d{{4}}$') THEN CAST(right(x, 4) AS INT) ELSE {THIS_YEAR} END AS b FROM y_),
m1 AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y2 WHERE b >= a),
m2 AS (SELECT *, count(*) FILTER (reach IS NULL OR a > reach + 1) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m1),
m3 AS (SELECT id, sum(y) AS years FROM (SELECT id, g, max(b) - min(a) AS y FROM m2 GROUP BY id, g) GROUP BY id)
SELECT resumes.id, CASE WHEN regexp_matches(lower(text), '\\b(?:fresher|fresh graduate|recent graduate|entry level|no experience|0\\s*\\+?\\s*years?)\\b') OR coalesce(years, 0) > {h.MOST_YEARS} THEN 0.0 ELSE CAST(coalesce(years, 0) AS DOUBLE) END AS years
FROM resumes LEFT JOIN m3 ON m3.id = resumes.id""")
def d19_years_from_section(spark, d):
    r = resumes(spark, d)
    return r.select("id", h.years_from_section(F.col("text"), s.content_of(F.col("text"), "experience"), THIS_YEAR).alias("years"))


@register(rf"""WITH {SECTIONS.split(',' + chr(10) + 'w_ AS')[0]}, y_ AS (SELECT id, unnest(regexp_extract_all(x, '{RANGE}', 0)) AS line FROM (SELECT id, unnest(string_split(text, chr(10))) AS x FROM resumes) WHERE regexp_matches(x, '(?i)\b(?:{h.CONTEXT})\b')),
z_ AS (SELECT id, {START} AS a, CASE WHEN {RUNS} THEN DATE '2030-01-01' ELSE {END} END AS b FROM y_)
SELECT id, count(*) AS ranges, CAST(min(a) AS VARCHAR) AS first, CAST(max(b) AS VARCHAR) AS last FROM z_ WHERE a IS NOT NULL AND b >= a GROUP BY id""")
def d18_dated_roles(spark, d):
    e = resumes(spark, d).select("id", F.explode(h.dated_roles(F.col("text"), THIS_YEAR)).alias("e"))
    end = F.coalesce("e.end", F.lit("2030-01-01").cast("date"))
    return e.groupBy("id").agg(F.count(F.lit(1)).alias("ranges"), F.min("e.start").cast("string").alias("first"), F.max(end).cast("string").alias("last"))


@register(r"""WITH y AS (SELECT id, regexp_extract_all(text, '(?i)\b(?:over|around|more\s+than)?\s*(\d+(?:\.\d+)?)\s*\+?\s*(?:years|yrs)\b', 1) AS y FROM resumes)
SELECT id, CASE WHEN len(y) > 0 THEN round(list_max(list_transform(y, lambda v: CAST(v AS DOUBLE))), 1) END AS years FROM y""")
def e10_told_years(spark, d):
    return resumes(spark, d).select("id", h.told_years(F.col("text")).alias("years"))


@register(rf"""WITH {LABELLED}, c1 AS (SELECT id, company, row_number() OVER (PARTITION BY id ORDER BY is_current DESC, coalesce("end", start) DESC, start DESC, b) AS r FROM labelled_ WHERE len(string_split(company, ' ')) <= 8 AND regexp_matches(company, '{k.word(k.COMPANY_WORDS)}|^[A-Z][A-Za-z0-9&.''\-]{{2,}}$'))
SELECT id, company FROM c1 WHERE r = 1""")
def e9_current_company(spark, d):
    """The company of the latest entry that holds; all of them stand in the section."""
    e = _experience(spark, d).select("id", "content", F.posexplode(h.labelled_entries(F.col("content"), THIS_YEAR)).alias("k", "e")).select("id", "k", "e.*", k.valid_company(F.col("e.company"), F.col("content")).alias("valid"))
    by = W.partitionBy("id").orderBy(F.col("is_current").desc(), F.coalesce("end", "start").desc(), F.col("start").desc(), "k")
    return e.filter("valid is not null").withColumn("r", F.row_number().over(by)).filter("r = 1").select("id", F.col("valid").alias("company"))


def _planted(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + f"][id % {len(xs)} + 1]"


@register(f"SELECT id, {_planted(made.PEOPLE)} AS name FROM resumes")
def t42_names(spark, d):
    """The name that each résumé begins with; the SQL knows which was put there."""
    return resumes(spark, d).select("id", k.name_of_resume(F.col("text")).alias("name"))


@register(f"SELECT id, {_planted(made.PLACES)} AS place FROM resumes")
def t43_places(spark, d):
    """The place beside the name; the SQL knows which was put there."""
    return resumes(spark, d).select("id", k.place_of_resume(F.col("text")).alias("place"))


@register(rf"""WITH {EXPERIENCE}, x AS (SELECT id, n, regexp_extract(line, 'I worked as (Lead Designer) and joined Initech from', 1) AS role, regexp_extract(line, 'joined Initech from (\d{{4}}) to', 1) AS a, regexp_extract(line, ' to (\d{{4}}) there', 1) AS b FROM e_ WHERE regexp_matches(line, 'joined Initech from \d{{4}} to \d{{4}} there'))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS k, 'Initech' AS company, role, a || '-01' AS a, b || '-12' AS b FROM x""")
def e5_prose_entries(spark, d):
    e = _listed(spark, d, h.prose_entries)
    month = lambda c: F.date_format(c, "yyyy-MM")
    return e.select("id", F.col("k").cast("long").alias("k"), "e.company", "e.role", month("e.start").alias("a"), month("e.end").alias("b"))


@register(r"""WITH x AS (SELECT id, unnest(regexp_extract_all(text, '\b(?i:FY|AY)\s*(\d{4}[-/](?:\d{4}|\d{2}))\b', 1)) AS y FROM resumes), z AS (SELECT id, CAST(y[1:4] AS INT) AS a, CASE WHEN length(y) = 9 THEN CAST(y[6:9] AS INT) ELSE CAST(y[1:2] || y[6:7] AS INT) END AS b FROM x)
SELECT id, count(*) AS spans, min(a) || '-01-01' AS first, max(b) || '-12-31' AS last FROM z WHERE b >= a GROUP BY id""")
def d11_fiscal_years(spark, d):
    e = resumes(spark, d).select("id", F.explode(h.fiscal_years(F.col("text"))).alias("s"))
    return e.groupBy("id").agg(F.count(F.lit(1)).alias("spans"), F.min("s.start").cast("string").alias("first"), F.max("s.end").cast("string").alias("last"))


@register(f"""WITH {LABELLED}, y_ AS (SELECT id, year(start) AS a, CASE WHEN is_current THEN {THIS_YEAR} ELSE year("end") END AS b FROM labelled_),
m1 AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y_ WHERE b >= a),
m2 AS (SELECT *, count(*) FILTER (reach IS NULL OR a > reach + 1) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m1),
m3 AS (SELECT id, sum(y) AS years FROM (SELECT id, g, max(b) - min(a) AS y FROM m2 GROUP BY id, g) GROUP BY id),
t1 AS (SELECT id, list_max(list_transform(regexp_extract_all(text, '(?i)\\b(?:over|around|more\\s+than)?\\s*(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*(?:years|yrs)\\b', 1), lambda v: CAST(v AS DOUBLE))) AS told FROM resumes)
SELECT t1.id, coalesce(CAST(nullif(m3.years, 0) AS DOUBLE), round(told, 1), 0.0) AS years FROM t1 LEFT JOIN m3 ON m3.id = t1.id""")
def o4_years_cascade(spark, d):
    """Years by dated entries, else as the text claims, else 0."""
    text = F.col("text")
    dated = h.years_of_entries(h.labelled_entries(s.content_of(text, "experience"), THIS_YEAR), THIS_YEAR)
    return resumes(spark, d).select("id", let(dated, lambda n: F.coalesce(F.when(n != 0, n), h.told_years(text), F.lit(0.0))).alias("years"))


@register("""WITH u AS (SELECT doc_id AS id, doc_id % 50 AS job, sha256(coalesce(text, '')) AS print FROM documents), old AS (SELECT job, print FROM u WHERE id % 7 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY job, print ORDER BY id) AS r FROM u WHERE id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM old WHERE old.job = u.job AND old.print = u.print))
SELECT id, job FROM f WHERE r = 1""")
def o5_bulk_upload(spark, d):
    """Uploads that are new for their job: not stored before, and the first of their batch."""
    every = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("job"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("print"))
    stored = every.filter("id % 7 = 0").select("job", "print")  # what earlier uploads have left
    return x.new_uploads(every.filter("id % 7 <> 0"), stored, ["job", "print"], "id").select("id", "job")


AS_OF = "2024-06-15"


@register()
def e3_block_entries(spark, d):
    """Entries of the blocks of all work histories."""
    e = wh.block_entries(made.work_histories(spark, d), "id", "content", AS_OF)
    return e.select("id", F.col("part").cast("long").alias("part"), "company", "role", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "is_current", "months", "confidence")


@register()
def e6_line_entries(spark, d):
    """Entries of the second layer, without those that are told twice."""
    e = wh.line_entries(made.work_histories(spark, d), "id", "content", AS_OF)
    return e.select("id", F.col("part.part").cast("long").alias("part"), F.col("part.k").cast("long").alias("k"), "company", "role", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "is_current", "months", "confidence")


@register()
def o3_total_experience(spark, d):
    """Total experience of all work histories, by the layer that says more."""
    return wh.total_experience(made.work_histories(spark, d), "id", "content", AS_OF)
