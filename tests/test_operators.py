"""Joins, order-dependent operators and empty inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crewlens.operators import billing, joins, windows


def test_first_within(spark):
    rows = [(1, "k", 0), (2, "k", 100), (3, "k", 400), (4, "j", 50)]
    df = spark.createDataFrame(rows, "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in billing.first_within(df, ["key"], 180).collect()) == [1, 3, 4]


def test_consumption_refuses_only_what_does_not_fit(spark):
    rows = [(1, 3), (2, 3), (3, 1), (4, 1), (5, 1)]
    df = spark.createDataFrame(rows, "id long, amount int").selectExpr("*", "7 as agency_id", "'interview' as feature", "timestamp_seconds(id) as ts")
    got = {r.id: (r.accepted, r.used_after) for r in billing.consumed(df, {"interview": 5}, "1970-01-01").collect()}
    assert got == {1: (True, 3), 2: (False, 3), 3: (True, 4), 4: (True, 5), 5: (False, 5)}
    assert all(r.accepted for r in billing.consumed(df, {"interview": None}, "1970-01-01").collect())


def test_charges_are_idempotent(spark):
    interviews = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("c", 1, False), ("d", 9, True)], "id string, candidate_id long, is_billable boolean")
    candidates = spark.createDataFrame([(1, None, 5)], "id long, agency_id int, job_id long")
    jobs = spark.createDataFrame([(5, 2)], "id long, agency_id int")
    users = spark.createDataFrame([(8, 2, "admin", 1), (9, 2, "admin", 50)], "id long, agency_id int, role string, wallet_balance int")
    ledger = spark.createDataFrame([], "user_id long, description string")
    first = billing.charges(interviews, candidates, jobs, users, ledger)
    assert sorted((r.interview_id, r.user_id, r.balance_after) for r in first.collect()) == [("a", 8, 0), ("b", 8, 0)]
    done = first.select("user_id", F.concat(F.lit(billing.BILLED), "interview_id").alias("description"))
    assert billing.charges(interviews, candidates, jobs, users, done).isEmpty()


def test_intervals(spark):
    rows = [("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-02-01", "2024-02-05")]
    df = spark.createDataFrame(rows, "a string, b string").selectExpr("1 as k", "date(a) as a", "date(b) as b")
    got = windows.merge_intervals(df, "k", "a", "b").orderBy("a").collect()
    assert [(str(r.a), str(r.b), r.pieces) for r in got] == [("2024-01-01", "2024-01-20", 2), ("2024-02-01", "2024-02-05", 1)]
    assert windows.merge_intervals(df.limit(0), "k", "a", "b").isEmpty()


def test_any_key_and_related(spark):
    left = spark.createDataFrame([(1, "A"), (2, None)], "l long, k string")
    right = spark.createDataFrame([(10, " a ", "2"), (11, None, None)], "r long, x string, y string")
    got = joins.any_key(left, "l", [F.col("l"), F.col("k")], right, "r", [F.col("x"), F.col("y")])
    assert {tuple(r) for r in got.collect()} == {(1, 10), (2, 10)}
    people = spark.createDataFrame([(1, "2"), (2, "C2"), (3, None)], "id long, code string")
    assert {tuple(r) for r in joins.related(people, "id", F.col("code")).collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


def test_first_source(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    got = joins.first_source("k", rows((1, "a")), rows((1, "b"), (2, "b")), rows((2, "c"), (3, "c")))
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "b"), (3, "c")}


@pytest.mark.parametrize(("total", "used", "amount", "left", "ok"), [(5, 3, 2, 2, True), (5, 9, 1, 0, False), (None, 9, 1, None, True)])
def test_limits(one, total, used, amount, left, ok):
    args = [F.lit(x).cast("int") for x in (total, used, amount)]
    assert one(billing.remaining(*args[:2])) == left
    assert one(billing.allowed(*args)) is ok
