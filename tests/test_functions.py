"""Text, date, list and score expressions on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crewlens.functions import arrays as a
from crewlens.functions import dates as d
from crewlens.functions import scoring as s
from crewlens.functions import text as t
from crewlens.operators import matching


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (t.line_breaks, "a\r\nb\rc", "a\nb\nc"),
        (t.line_breaks, None, ""),
        (t.artifacts, "(cid:12)M arch 2020 – JOHN SON me @ mail . com", " March 2020 - JOHNSON me@mail.com"),
        (t.without_urls, "see https://x.y/z?q=me@mail.com, www.site.org/a", "see  me@mail.com   "),
        (t.without_bullets, "• one\n - two\n3", "one\ntwo\n3"),
        (t.without_special_characters, "a™b == c,,, (x)) ok__", "a b    c, (x) ok "),
        (t.repaired_date_ranges, "Jan 2020 ?? Present; 2019  2020", "Jan 2020 - Present; 2019 - 2020"),
        (t.normalized, " a  | b \n\n\n\n c ", "a | b\n\nc"),
        (t.safe_clean, "a\t  b   c  d \n\n\n\n\n e", "a  b  c d\n\n\n e"),
        (t.capitalised, "hELLO wORLD", "Hello world"),
        (t.job_type, "Part-Time role", "Part-time"),
        (t.job_salary, "3 rooms, pay 45000", "$45000"),
        (t.resume_type, "CRM and sales, python", "sales"),
        (t.resume_type, "", "general"),
        (t.plain_location, "Room 12", None),
    ],
)
def test_text(one, f, given, wanted):
    assert one(f(F.lit(given))) == wanted


def test_slugs(one):
    uid = "0a1b2c3d-0000-4000-8000-0123456789ab"
    assert one(t.job_slug(F.lit("Sr. Dev!! / API"), F.lit("Pune"), F.lit(7))) == "sr-dev-api-pune-7"
    assert one(t.id_of_slug(F.lit(f"dev-{uid.upper()}"))) == uid
    assert one(t.id_of_slug(F.lit("dev"))) is None


def test_salary(one):
    assert tuple(one(t.salary_range(F.lit("$70,000 - 50,000 per year")))) == (50000.0, 70000.0, "YEAR", "USD")
    assert tuple(one(t.salary_range(F.lit("€30/hr")))) == (30.0, None, "HOUR", "USD")
    assert tuple(one(t.salary_range(F.lit(None).cast("string")))) == (None, None, "YEAR", "USD")


def test_sections(one):
    lines = one(t.sections(F.lit("Ann\n\nSkills:\nSQL\nWork Experience\nX"), t.HEADERS))
    assert [(x["line"], x["opens"]) for x in lines] == [("Ann", None), ("Skills:", "skills"), ("SQL", None), ("Work Experience", "experience"), ("X", None)]


def test_contacts(one):
    assert one(t.emails(F.lit("A@corp.example b@gmail.com a@corp.example"))) == ["b@gmail.com", "a@corp.example"]
    assert one(t.phones(F.lit("+91 98765-43210, 12345"))) == ["+919876543210"]
    assert one(t.rendered(F.lit("Hi {{name}}{{x}}"), {"name": F.lit("X"), "x": F.lit(None)})) == "Hi X"


@pytest.mark.parametrize(("said", "date"), [("Mar 49", "2049-03-01"), ("Mar 50", "1950-03-01"), ("07.15", "2015-07-01"), ("1999", "1999-01-01"), ("13/2001", None), ("x", None), ("", None), ("2090", None)])
def test_months(one, said, date):
    assert one(d.month_date(F.lit(said), 2050).cast("string")) == date


def test_spans(one):
    day = lambda x: F.lit(x).cast("date")
    assert one(d.months_inclusive(day("2023-01-01"), day("2023-01-31"))) == 1
    assert one(d.duration_text(F.lit(27))) == "2 years 3 months"
    assert [str(x) for x in one(d.fiscal_span(F.lit("FY2021-22")))] == ["2021-01-01", "2022-12-31"]
    assert one(d.elapsed_days(F.lit("2024-01-01 23:00").cast("timestamp"), F.lit("2024-01-03 01:00").cast("timestamp"))) == 1
    assert one(d.valid_span(day(None), day("2023-01-31"), day("2024-01-01"))) is False
    assert d.preset("last_7", "2024-03-10") == ("2024-03-04", "2024-03-10")
    with pytest.raises(ValueError, match="no such preset"):
        d.preset("ever", "2024-03-10")


def test_lists(one):
    words = lambda *x: F.array(*[F.lit(y) for y in x])
    assert one(a.distinct_ignoring_case(words(" SQL", "sql", "", "Go"))) == ["SQL", "Go"]
    assert one(a.skill_list(F.lit('["a","A","b"]'))) == ["a", "b"]
    assert one(a.skill_list(F.lit(None).cast("string"))) == []
    assert tuple(one(a.overlap(words("SQL", "go"), words("sql", "rust")))) == (1, 1, 1, 0.5, 0.5)
    assert one(a.json_without_empty(x=a.text_or_null(F.lit(" ")), y=F.lit(1))) == '{"y":1}'


def test_scores(one):
    lit = F.lit
    assert one(s.interview_score(lit(None), lit(80), lit(70), lit(60))) == 7.3
    assert one(s.interview_score(lit(55), lit(None), lit(70), lit(60))) == 5.5
    assert one(s.to_ten(lit(None))) is None
    assert tuple(one(s.ranking(dict.fromkeys(s.WEIGHTS, lit(100))))) == (1.0, 100.0)
    assert one(s.education_score(lit("B.Tech CSE, pursuing"))) == 8.0
    assert one(s.skills_score(lit("Skills\njs, SQL\nExperience\nBuilt sql tools"), F.array(lit("JavaScript"), lit("sql")), lit(13))) == 9.5
    assert one(s.skills_score(lit("fresher\nSkills\nsql"), F.array(lit("sql")), lit(0))) == 0.0
    assert one(s.location_score(lit("Pune"), lit("pune"))) == 5.0


def test_matching(spark):
    pairs = spark.createDataFrame([(1, "python sql data", "python sql data"), (2, "python", "cobol"), (3, None, "x y"), (4, "", "")], "k long, a string, b string")
    got = {r.k: (r.tfidf, r.bm25, r.combined) for r in matching.match(pairs, "k", "a", "b").collect()}
    assert got == {1: (100.0, 100.0, 100.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_phrases_prefer_the_longest(spark):
    docs = spark.createDataFrame([(1, "Machine Learning models in SQL"), (2, None)], "k long, text string")
    words = spark.createDataFrame([("machine", "m"), ("machine learning", "ml"), ("learning models", "lm"), ("sql", "sql")], "phrase string, label string")
    assert sorted((r.k, r.position, r.label) for r in matching.phrases(docs, "k", "text", words).collect()) == [(1, 1, "ml"), (1, 5, "sql")]


def test_words_end_at_other_letters(one):
    """As in SQL, a word ends at a letter that is not ASCII; before, it went on there."""
    from crewlens.functions import checks as k

    none = F.array().cast("array<string>")
    assert one(k.valid_role(F.lit("The qaé"), none)) == "The qaé"
    assert one(k.role_confidence(F.lit("The qaé"))) == 1.0
    assert one(k.valid_name(F.lit("Ana éey"))) == ""
    assert one(t.artifacts(F.lit("ESCI LLAR OSÑ"))) == "ESCI LLAROSÑ"
    assert one(t.artifacts(F.lit("an.66@mail9.example.com oution oi. Airé eau"))) == "an.66@mail9.example.comoutionoi.Airé eau"


def test_address_before_many_words(one):
    """An address with 60,000 words after it; a group repeated once a word overflowed the matcher's stack."""
    assert one(F.length(t.artifacts(F.lit("a@b " + "word " * 60_000)))) == 300_004


def test_role_behind_a_mark_is_judged_as_in_sql(spark, tmp_path):
    """``t29_names_and_roles`` took numbers and marks off a text before its words were counted; its SQL counts them."""
    import duckdb

    from crewlens.plans import catalogue

    texts = ["- lead", "1) QA", "* product lead for one two three four five six seven eight nine ten", "- team lead", "lead", "• sales * x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalogue.oracles()["t29_names_and_roles"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["t29_names_and_roles"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
