"""How often expressions search their texts: each pattern stands once or a few times in the plan, however deep its uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.functions import dates, history, sections
from crewlens.operators import people
from crewlens.plans import resumes

TEXT = "Ann Lee\nSKILLS\nPython\nWORK EXPERIENCE\nOrganization: Acme\n2001 - 2004\nTechnical skills: SQL\nSummary\nx"


def written(spark, c):
    return spark.createDataFrame([(1, TEXT)], "id int, text string").select(c)._jdf.queryExecution().analyzed().toString()


def test_a_date_is_searched_by_one_form(spark, one):
    assert written(spark, dates.month_date(F.col("text"), 2030)).count("regexp_extract") <= 8  # 168 before
    said = ("Jan 1998", "sept. 01", "7/2018", "13/2018", "1950", "1949", "2031", "x", "", "Foo 2001")
    got = one(F.array(*[dates.month_date(F.lit(x), 2030).cast("string") for x in said]))
    assert got == ["1998-01-01", "2001-09-01", "2018-07-01", None, "1950-01-01", None, None, None, None, None]


def test_some_sections_are_those_of_all(spark):
    df = spark.createDataFrame([(1, TEXT)], "id int, text string")
    every = {s["section"]: s["content"] for s in df.select(sections.segmented(F.col("text"))).first()[0]}
    for name in ("skills", "experience"):
        assert [tuple(s) for s in df.select(sections.segmented(F.col("text"), (name,))).first()[0]] == [(name, every[name])]


def test_sections_are_spanned_once(spark):
    plan = written(spark, sections.segmented(F.col("text")))
    assert plan.count(sections.CONTACT) <= 4  # 56 before


def test_years_cut_the_text_to_sections_once(spark):
    c = history.years_from_section(F.col("text"), sections.content_of(F.col("text"), "experience"), resumes.THIS_YEAR)
    assert written(spark, c).count("linguistic proficiency") <= 11  # 44 before


def test_lines_that_may_open_a_section(spark):
    groups = [x for group in (sections.TERMS, sections.NAMES) for x in group.values()] + ["awards|references|internships|key product launches"]
    lines = [(f" *1. {term.upper()}:",) for terms in groups for term in terms.split("|")]
    assert spark.createDataFrame(lines, "x string").filter(~F.col("x").rlike(sections.MAY_OPEN)).count() == 0


def test_a_long_line_is_no_name(one):
    assert one(people.best_name(F.lit("one two three four five six\nann lee\nAnn Marie Lee 5 Main Street"))) == "Ann Marie Lee"
