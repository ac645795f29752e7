"""The listing's display override and asynchronous interviews over all candidates."""

from __future__ import annotations

import datetime as dt

from crewlens.plans import catalogue, filters, listings
from crewlens.sources import views as v

D = "/root/testdata/sf0.001"


def test_display_override(spark):
    day = lambda k: dt.date(2001, 8, 1) + dt.timedelta(k)
    at = lambda k, h=12: dt.datetime(2001, 8, 1, h) + dt.timedelta(k)
    c = spark.createDataFrame([(k, f"C{k}", "INTERVIEW_RESCHEDULED" if k == 5 else "APPLIED") for k in range(1, 10)], "id long, code string, stage string")
    slots = [("C1", day(0)), ("2", day(3)), ("2", day(-3)), ("{c3}", day(-1)), (" c5 ", day(0)), ("c7", day(2)), ("c7", day(0)), ("x", day(0))]
    s = spark.createDataFrame(slots, "candidate string, slot_date date")
    seen = [(2, "completed", at(0)), (3, "scheduled", at(2)), (4, "in progress", at(-9)), (5, "completed", at(0)), (6, "scheduled", at(-2)), (8, "rejected", at(0)), (9, "Scheduled", None)]
    i = spark.createDataFrame([(str(k), *r, at(-20)) for k, r in enumerate(seen)], "id string, candidate_id long, status string, scheduled_at timestamp, created_at timestamp")
    got = {r.id: r.stage for r in listings.displayed(c, s, i, v.AS_OF).collect()}
    seen, coming = "INTERVIEWED", "INTERVIEW_SCHEDULED"
    assert got == {1: seen, 2: coming, 3: coming, 4: seen, 5: "INTERVIEW_RESCHEDULED", 6: "APPLIED", 7: seen, 8: "APPLIED", 9: coming}


def test_no_candidate_is_left_out(spark):
    ids = lambda rows: sorted(r.id for r in rows.select("id").collect())
    assert ids(catalogue.queries()["p18_display_override"](spark, D)) == ids(v.candidates(spark, D))
    assert ids(catalogue.queries()["q19_async_by_candidate"](spark, D)) == ids(v.interviews(spark, D).filter("is_async"))


def test_rows_beyond_the_first_are_not_gathered(spark):
    from pyspark.sql import functions as F

    from crewlens.operators import scope

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (0, "z"), (2, "b"), (2, "b"), (3, "c")], "n int, s string")
    ordered = sorted(tuple(r) for r in rows.collect())
    for skip in (1, 2, 3, 4, 5, 7, 9):
        assert sorted(tuple(r) for r in scope.beyond(rows, F.struct("n", "s"), skip).collect()) == ordered[skip:]
    plan = filters.l2_offset_without_limit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "offset" not in plan.lower()


def test_interviews_are_searched_before_they_are_joined(spark):
    from crewlens.operators import scope

    i = spark.createDataFrame([("a", 1, "x No-Show", None), ("b", 2, None, "NO-SHOW"), ("c", 3, "s", None), ("d", 4, "s", None), ("e", 5, None, None), ("f", None, None, None), ("g", 9, "s", "t")], "id string, candidate_id long, status string, transcript string")
    c = spark.createDataFrame([(1, "no-show", 7), (2, "x", 8), (3, "A no-show", None), (4, None, 7), (5, "y", 8)], "id long, name string, job_id long")
    j = spark.createDataFrame([(7, "the no-show"), (8, None)], "id long, title string")
    assert sorted(r.id for r in scope.search_interviews(i, c, j, "no-SHOW").collect()) == ["a", "b", "c", "d"]
