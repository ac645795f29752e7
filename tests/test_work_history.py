"""Work history from free text against a plain reading, one section at a time."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crewlens.functions import history as h
from crewlens.functions import worklines as wl
from crewlens.operators import windows, work_history
from crewlens.sources.resumes import work_histories

from . import plain_history as plain
from .conftest import DATA

AS_OF = "2024-06-15"
TODAY = dt.date(2024, 6, 15)


@pytest.fixture(scope="module")
def sections(spark):
    """All made work histories, and awkward ones."""
    odd = [
        (-1, None), (-2, ""), (-3, "\n\n"), (-4, "2010 - 2012"), (-5, "Engineer\n2012 - 2010"), (-6, "QA Lead\nAcme Ltd\n2030 - 2031"), (-7, "at at in in | | - - "),
        (-8, "Lead Engineer\nGlobex Systems\n1970 - 2023"), (-9, "* Engineer\n* Acme Ltd 2001 - 2003"), (-10, "Data Analyst | Acme Ltd | Jan 2010 - Feb 2012\n" * 3),
        (-11, "Senior Developer Acme, Pune, India\nMay 2001 - May 2003"), (-12, "Roles and responsibilities at Acme Ltd\nJan 2001 - Jan 2002"),
        (-13, "Product Manager - Initech Ltd\n(2004 - 2006)\nSkills\nPython Developer"), (-14, "Worked with Hooli Labs from 12/03/2010 to 1st"), (-15, "Sales Executive @ Acme Works\n5 Jan 2010 - Feb 3rd, 2012"),
    ]
    made = work_histories(spark, DATA)
    return made.unionByName(spark.createDataFrame(odd, "id long, content string")).cache()


@pytest.fixture(scope="module")
def contents(sections):
    return {r.id: r.content for r in sections.collect()}


def rows(frame):
    return sorted(((r.id, r.company, r.role, r.start, r.end, r.is_current, r.months, r.confidence) for r in frame.collect()), key=repr)


def wanted(found):
    return sorted(((i, e["company"], e["role"], e["start"], e["end"], e["current"], e["months"], e["confidence"]) for i, some in found.items() for e in some), key=repr)


def test_block_entries(sections, contents):
    got = rows(work_history.block_entries(sections, "id", "content", AS_OF))
    want = wanted({i: plain.block_entries(c, TODAY) for i, c in contents.items()})
    assert len(want) > 300
    assert got == want


def test_line_entries(sections, contents):
    got = rows(work_history.line_entries(sections, "id", "content", AS_OF))
    want = wanted({i: plain.line_entries(c, TODAY) for i, c in contents.items()})
    assert len(want) > 500
    assert got == want


def test_total(sections, contents):
    """Both layers summed up, and the choice between them, from the entries."""
    layers = []
    for of in (work_history.first_layer_entries, work_history.line_entries):
        each: dict = {i: [] for i in contents}
        for r in of(sections, "id", "content", AS_OF).collect():
            each[r.id].append(r)
        layers.append(each)
    blocks = {(i, e["company"], e["start"], e["end"]) for i, c in contents.items() for e in plain.block_entries(c, TODAY)}
    first = {(r.id, r.company, r.start, r.end) for some in layers[0].values() for r in some}
    assert len(blocks - first) < 0.1 * len(blocks)  # those that are told twice

    def summed(some):
        last = max(some, key=lambda r: (r.is_current, r.end, r.start), default=None)
        sure = plain.two_places(sum(r.confidence for r in some) / len(some)) if some else 0.0
        return len(some), plain.merged([(r.start, r.end) for r in some]), sure, last

    seen = set()
    for r in work_history.total_experience(sections, "id", "content", AS_OF).collect():
        a, b = summed(layers[0][r.id]), summed(layers[1][r.id])
        current = b[3] is not None and (b[3].company is not None or b[3].role is not None)
        second = b[0] > 0 and (a[0] == 0 or b[1] > a[1] or (current and a[3] is None) or (b[0] > a[0] and b[2] >= max(a[2] - 0.05, 0)))
        n, months, _, last = b if second else a
        if months > work_history.MOST_MONTHS:
            n, months, last = 0, 0, None
            seen.add("too long")
        assert r.layer == ("layer2" if second else "layer1"), r
        seen.add(r.layer)
        assert (r.entries, r.months) == (n, months), r
        assert r.years == (round(months / 12 + 1e-9, 1) if months else None)
        assert r.since == (f"{last.start:%Y-%m}" if last else None)
        assert r.needs_review == (n > 0 and months == 0)
    assert seen == {"layer1", "layer2", "too long"}


def test_merged_months_like_rows(spark, sections):
    """The fold in a row and the windows over rows join the same intervals."""
    entries = work_history.line_entries(sections, "id", "content", AS_OF).select("id", "start", "end").cache()
    in_row = {r.id: r.m for r in entries.groupBy("id").agg(wl.merged_months(F.collect_list(F.struct("start", "end"))).alias("m")).collect()}
    islands: dict = {}
    for r in windows.merge_intervals(entries, "id", "start", "end").collect():
        islands[r.id] = islands.get(r.id, 0) + plain.months(r.start, r.end)
    assert in_row == islands and len(in_row) > 100


TOKENS = (
    ("Jan 2010", "2010-01-01", "2010-01-31"), ("sept'11", "2011-09-01", "2011-09-30"), ("2/2012", "2012-02-01", "2012-02-29"), ("02.49", "2049-02-01", "2049-02-28"), ("02.50", "1950-02-01", "1950-02-28"),
    ("2010.04", "2010-04-01", "2010-04-30"), ("2010-11", "2010-11-01", "2010-11-30"), ("2010", "2010-01-01", "2010-12-31"), ("FY 2019-20", "2019-01-01", "2020-12-31"), ("AY2019", "2019-01-01", "2019-12-31"),
    ("1999-01", "1999-01-01", "1999-01-31"), ("2019-21", "2019-01-01", "2021-12-31"), ("5 March 2010", "2010-03-05", "2010-03-05"), ("Feb 30, 2010", None, None), ("31/12/2010", "2010-12-31", "2010-12-31"), ("13/2010", None, None),
    ("now", AS_OF, AS_OF), ("", None, None), ("soon", None, None),
)


def test_dates(spark):
    day, token = F.lit(AS_OF).cast("date"), F.col("token")
    frame = spark.createDataFrame([(t,) for t, *_ in TOKENS], "token string")
    got = {r.token: (r.a, r.b) for r in frame.select("token", wl.date_of(token, False, day).alias("a"), wl.date_of(token, True, day).alias("b")).collect()}
    assert {t: tuple(str(x) if x else None for x in v) for t, v in got.items()} == {t: (a, b) for t, a, b in TOKENS}
    assert got == {t: tuple(plain.date_of(t, is_end, TODAY) for is_end in (False, True)) for t, *_ in TOKENS}


def test_inline_entries_stop_at_the_next(one):
    line = "Data Analyst | 06/2010 to 2012 Vandelay Inc Led a team of four QA Engineer | 2012 - Present Soylent Corp Built tests KEY PROJECTS Alpha"
    got = one(h.inline_entries(F.lit(line), F.lit(AS_OF).cast("date")))
    assert [(e.role, e.company, e.is_current) for e in got][0] == ("Data Analyst", "Vandelay Inc", False)
    assert got[1].company == "Soylent Corp" and got[1].is_current and got[1].description == "Built tests"


def test_prose_entries_look_around(one):
    far = "x" * 130
    texts = {
        "I was a Lead Designer then.\nLater I joined Wayne Corp from 2001 to 2003 there": "Lead Designer",
        f"I was a Lead Designer then {far}\nand joined Wayne Corp from 2001 to 2003": None,
        f"joined Wayne Corp from 2001 to 2003 {far[:60]} as Data Analyst": "Data Analyst",
    }
    for text, role in texts.items():
        got = one(h.prose_entries(F.lit(text), F.lit(AS_OF).cast("date")))
        assert [(e.company, e.role) for e in got] == [("Wayne Corp", role)], text
    assert one(h.prose_entries(F.lit(None).cast("string"), F.lit(AS_OF).cast("date"))) == []


FORM = rf"(?i)([A-Z][A-Za-z0-9&.'-]*(?:\s+[A-Z][A-Za-z0-9&.'-]*)*\s+(?:{wl.COMPANY_FORMS}))\b"


def test_company_form(spark):
    """The same as one pattern with a repeated group gives, which is too deep for long lines."""
    import itertools
    import re

    words = ["Acme", "3Com", "Labs", "labs_x", "Pvt. Ltd.", "Ltd", "o'Neil-x", ",", "(At", "Inc,", "9 Works", "-", "& Schools", "School"]
    lines = [" ".join(x) for n in (1, 2, 3, 4) for x in itertools.product(words, repeat=n)]
    frame = spark.createDataFrame([(x,) for x in lines], "c string").repartition(4)
    for line, got in frame.select("c", wl.formed(F.col("c"))).collect():
        found = re.search(FORM, line, re.ASCII)
        assert got == (found.group(1) if found else None), line


LONG = "Analyst 2010 - 2012 in " + "plain words " * 15_000


@pytest.mark.parametrize("entries", [work_history.block_entries, work_history.line_entries, work_history.total_experience])
def test_long_lines(spark, entries):
    """A line of 30,000 words, and one that ends in a company's form, are read; the matcher overflowed its stack before."""
    texts = [(1, LONG), (2, f"Acme {LONG} Labs\nMay 2001 - May 2003"), (3, "QA Lead\nAcme Labs\n2010 - 2012")]
    found = entries(spark.createDataFrame(texts, "id long, content string"), "id", "content", AS_OF).collect()
    assert [r.company for r in found if r.id == 3] == ["Acme Labs"]


def test_words_are_found_as_by_trying_each(spark):
    """The patterns that look at first letters first find what plain alternatives find."""
    lists = (wl.ROLE_WORDS, wl.COMPANY_WORDS, wl.TITLE_WORDS, wl.TITLE_HEADS, wl.ACTION_WORDS, wl.NO_COMPANY_WORDS, wl.SKILL_WORDS, "|".join(wl.PLACES))
    texts = [f"{a}{w.upper() if n % 2 else w}{b}" for words in lists for n, w in enumerate(words.split("|")) for a, b in (("", ""), ("x", ""), ("to ", "s"), ("É", "é"), ("(", ") 1"))]
    texts += ["May 2001 - 3.2004", "1 Jan 2001", "marching 2001", "decem 12", "Sept, 5th 2010 to now", "2010/11", "Ju 2001", "JUNE'07"]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    date = f"(?:{'|'.join(wl.DATE_FORMS)})"
    pairs = [(rf"(?i)\b{wl.any_word(w)}\b", rf"(?i)\b(?:{w})\b") for w in lists] + [(f"(?i){wl.DATE}", f"(?i){date}")]
    found = lambda p: F.regexp_extract_all("x", F.lit(p), F.lit(0))
    differ = [p for quick, p in pairs if frame.filter(~found(quick).eqNullSafe(found(p))).count()]
    assert not differ


def test_readings_of_a_group_are_folds(spark, sections):
    """Lines of a group are read in one row, up to the first that holds: no window over a group, which would read them all."""
    groups = work_history.surroundings(sections, "id", "content", F.lit(TODAY))
    plan = work_history.read_groups(groups, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith("Window [") for line in plan.split("\n")) == 1  # lines before and after
