"""Closure over a hierarchy, page geometry, merging and wording of requirements on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from crewlens.functions import scoring as sc
from crewlens.operators import merging, pages, rescheduling, taxonomy
from crewlens.plans import cascades

from .conftest import DATA


def ancestors(edges):
    """(child, parent) to steps by a search from each child."""
    up: dict = {}
    for c, p in edges:
        if c is not None and p is not None and c != p:
            up.setdefault(c, set()).add(p)
    out = {}
    for c in up:
        seen, front, steps = {c}, {c}, 0
        while front:
            steps += 1
            front = {p for x in front for p in up.get(x, ())} - seen
            seen |= front
            out |= {(c, p): steps for p in front}
    return out


@pytest.mark.parametrize(
    "edges",
    [
        [(f"s{k}", f"s{k + 1}") for k in range(13)],
        [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e"), ("a", "b")],
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("a", None), ("d", "d")],
        [],
    ],
)
def test_closure(spark, edges):
    got = taxonomy.closure(spark.createDataFrame(edges, "lower string, upper string"), "lower", "upper")
    assert {(r.child, r.parent): r.steps for r in got.collect()} == ancestors(edges)


def test_closure_at_random(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    got = taxonomy.closure(spark.createDataFrame(edges, "child long, parent long"), "child", "parent")
    assert {(r.child, r.parent): r.steps for r in got.collect()} == ancestors(edges)


def test_marks_in_skills_are_plain(spark):
    rows = [("Knows C++ and .NET", "c++", True), ("c+++", "c++", True), ("c", "c++", False), (None, "go", False), ("gopher", "go", False), ("(go)", "go", True), ("a\\Eb", "\\e", False)]
    got = spark.createDataFrame(rows, "t string, s string, w boolean").select("w", taxonomy.holds(F.col("t"), F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [r.w for r in got]


def test_every_source_of_the_cascade_decides(spark):
    got = cascades.p12_synced_stages(spark, "/root/testdata/sf0.01").groupBy("via", "stage").count().collect()
    assert {r.via for r in got} == {"slot", "session", "interview"} and len(got) > 3


def test_columns_are_found_by_their_names(spark):
    assert rescheduling.resolved(spark.createDataFrame([], "Slot_Date date, CandidateId string"), ("candidateid", "candidate")) == "CandidateId"
    bare = rescheduling.slots_in_common_form(spark.createDataFrame([("c1",)], "candidate string")).collect()
    assert [tuple(r) for r in bare] == [("c1", None, None, None)]


def test_records_are_merged(spark):
    schema = "id long, name string, email string, job_id long, stage string, resume_score double, skills array<string>, current_role string, created_at timestamp, stage_entered_at timestamp, stage_updated_at timestamp"
    row = lambda i, name=None, email=None, job=None, stage="REVIEW", score=None, skills=None, role=None, at="2001-01-01": (i, name, email, job, stage, score, skills, role, at, None, None)
    rows = [
        row(1, "Ann", "ann@x", 7, "INTERVIEWED", 50.0),
        row(2, "Ann", None, None, "NO_SHOW", role="Lead"),  # a placeholder of the same day
        row(3, "Bob", "bob@x", 7, "SHORTLISTED", 10.0),
        row(4, "Ann", None, None, "INTERVIEWED", at="2001-01-02"),  # another day
        row(5, " ", None, None, "NO_SHOW"),
        row(6, "Cy", "", 9, "INTERVIEWED", skills=[]),  # complete by its job alone
        row(7, "cy ", None, 9, "NO_SHOW", 5.0),
    ]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr(*[f"cast({c} as timestamp) as {c}" if c.endswith("_at") else c for c in (x.split()[0] for x in schema.split(", "))])
    got = {r.id: r for r in merging.merged(df, ["email", "resume_score", "current_role", "skills"], ["created_at"]).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7}
    assert (got[1].email, got[1].resume_score, got[1].current_role, got[1].stage, got[1].merged) == ("ann@x", 50.0, "Lead", "NO_SHOW" if 73 > 60 + 12 else "INTERVIEWED", 1)
    assert got[6].email is None and got[6].skills is None
    assert merging.merged(df.limit(0), ["email"]).collect() == []


def plain_lines(words):
    lines, first = [], None
    for w in sorted(words, key=lambda w: (w[4], w[2], w[0])):
        if first is None or w[4] - first > 3:
            lines.append([])
            first = w[4]
        lines[-1].append(w)
    out = []
    for k, line in enumerate(lines):
        segments, last = [], None
        for w in sorted(line, key=lambda w: (w[2], w[4], w[0])):
            if last is None or w[2] - last > 35:
                segments.append([])
            segments[-1].append(w)
            last = w[3]
        out += [(k, s, " ".join(w[1].strip() for w in some), min(w[2] for w in some), max(w[3] for w in some)) for s, some in enumerate(segments)]
    return out


def test_words_to_lines(spark):
    """Heights that drift: a line ends three points below its first word, not below its last."""
    rng = random.Random(5)
    words = [(n, f"w{n}", float(rng.randint(0, 500)), 0.0, 0.0) for n in range(400)]
    words = [(n, t, x, x + rng.randint(5, 60), round(rng.random() * 60, 1)) for n, t, x, *_ in words]
    drift = [(1000 + k, f"d{k}", 40.0 * k, 40.0 * k + 20, 100 + 1.5 * k) for k in range(9)]
    every = words + drift
    rows = [(1, *w) for w in every] + [(2, 0, " ", 1.0, 2.0, 3.0), (2, 1, "x", None, 2.0, 3.0)]
    got = pages.words_to_lines(spark.createDataFrame(rows, "page int, n int, text string, x0 double, x1 double, top double"), ["page"])
    assert sorted((r.line, r.segment, r.text, r.x0, r.x1) for r in got.collect()) == sorted(plain_lines(every))


def test_columns_of_pages(spark):
    line = lambda page, k, x0, width: (page, k, 0, f"l{page}-{k}-{x0}", x0, x0 + width, 12.0 * k)
    rows = [line(1, k, 40.0, 100) for k in range(8)] + [line(1, k, 250.0, 200) for k in range(9)]
    rows += [line(2, k, 40.0, 100) for k in range(7)] + [line(2, k, 250.0, 200) for k in range(9)]  # too few on the left
    rows += [line(3, k, 40.0, 200) for k in range(8)] + [line(3, k, 250.0, 100) for k in range(9)]  # the left is wider
    rows += [line(4, k, 40.0, 100) for k in range(8)] + [line(4, k, 99.0, 200) for k in range(9)]  # too near
    lines = spark.createDataFrame(rows, "page int, line int, segment int, text string, x0 double, x1 double, top double")
    splits = pages.column_splits(lines, ["page"], 600.0)
    assert [(r.page, r.split) for r in splits.collect()] == [(1, 145.0)]
    order = [r.text for r in pages.reading_order(lines.filter("page = 1"), splits, ["page"]).orderBy("place").collect()]
    assert order == [f"l1-{k}-40.0" for k in range(8)] + [f"l1-{k}-250.0" for k in range(9)]
    assert len({r.text.count(" ") for r in cascades.t30_lines_of_pages(spark, DATA).filter("column = 1").collect()}) > 1


@pytest.mark.parametrize(("said", "least", "most"), [("3-5 years", 3.0, 5.0), ("5 TO 3", 3.0, 5.0), ("2.5+ yrs", 2.5, None), ("4", 4.0, 4.0), ("some", None, None), (None, None, None)])
def test_required_years(one, said, least, most):
    got = one(sc.required_years(F.lit(said).cast("string")))
    assert (got["least"], got["most"]) == (least, most)


def test_summary_without_data(one):
    none = F.array().cast("array<string>")
    got = one(sc.summary(none, none, F.lit(None).cast("double"), sc.required_years(F.lit(None).cast("string"))))
    assert got.text == sc.NO_SUMMARY
    full = one(sc.summary(F.array(F.lit("Node.js"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.array(F.lit("NODE.JS "), F.lit("A"), F.lit("b"), F.lit("c"), F.lit("d")), F.lit(4), sc.required_years(F.lit("2+"))))
    assert full.skills == "Matched core skills include Node.Js, A, B, C."
    assert full.text.count("\n• ") == 6 and full.fit.startswith("Overall fit appears strong")


def test_pages_are_sent_once(spark):
    """Lines, their splits and their order need one exchange of the words and no join; before, words met their heights and lines their splits in joins."""
    rows = [(p, i, f"w{i}", float(i % 7 // 3 * 240 + i % 3 * 40), float(i % 7 // 3 * 240 + i % 3 * 40 + 20), float(i // 7 * 12)) for p in (1, 2) for i in range(140)]
    words = spark.createDataFrame(rows, "page int, n int, text string, x0 double, x1 double, top double")
    lines = pages.words_to_lines(words, ["page"])
    ordered = pages.reading_order(pages.with_splits(lines, ["page"], 600.0), None, ["page"])
    plan = ordered._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    two = pages.reading_order(lines, pages.column_splits(lines, ["page"], 600.0), ["page"])
    assert sorted(map(str, ordered.select(*two.columns).collect())) == sorted(map(str, two.collect()))
