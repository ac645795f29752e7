"""Streams run over small files to the end."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crewlens.streaming import flows

T0 = dt.datetime(2024, 1, 1, 12, 0)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    def go(batches, schema, make, mode="append"):
        folder, out = tmp_path / "in", tmp_path / "out"
        result = None
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            stream = spark.readStream.schema(schema).parquet(str(folder))
            frame = make(stream)
            write = flows.into_table if mode == "append" else flows.upserts_into
            write(frame, str(out), str(tmp_path / "check")).awaitTermination()
            result = frame.schema
        if mode != "append":
            return [tuple(r) for r in flows.latest(spark, result, str(out), mode.split(",")).collect()]
        return [tuple(r) for r in spark.read.schema(result).parquet(str(out)).collect()]

    return go


def test_repeats_are_dropped_across_runs(run):
    schema = "key string, n int, ts timestamp"
    batches = [[("a", 1, at(0)), ("a", 2, at(1))], [("a", 3, at(2)), ("b", 4, at(2))]]
    got = run(batches, schema, lambda s: flows.without_repeats(s, ["key"]))
    assert sorted(k for k, *_ in got) == ["a", "b"]


def test_sessions(run):
    got = run([[("u", at(0)), ("u", at(10)), ("u", at(50)), ("w", at(500))]], "user string, ts timestamp", lambda s: flows.sessions(s, "user"))
    assert sorted(n for *_, n in got) == [1, 2]  # the last is still open


def test_changed_windows_replace_earlier_ones(run):
    batches = [[("u", 1.0, at(0))], [("u", 2.0, at(5)), ("w", 1.0, at(6))]]
    got = run(batches, "user string, value double, ts timestamp", lambda s: flows.usage_windows(s, ["user"], "value", "1 day", "1 hour"), "user,start")
    assert sorted((u, used, n) for u, _, used, n in got) == [("u", 3.0, 2), ("w", 1.0, 1)]


def test_late_rows_are_left_out(run):
    schema = "user string, value double, ts timestamp"
    batches = [[("u", 1.0, at(0))], [("u", 1.0, at(100_000))], [("u", 5.0, at(1))], [("u", 1.0, at(200_000))]]
    got = run(batches, schema, lambda s: flows.usage_windows(s, ["user"], "value", "1 day", "1 hour"))
    assert (T0.replace(hour=0), 1.0) in {(start, used) for _, start, used, _ in got}


def test_no_show_timer(run):
    schema = "candidate_id long, status string, scheduled_at timestamp, ts timestamp"
    batches = [
        [(1, "scheduled", at(10), at(0)), (2, "scheduled", at(10), at(0)), (3, "scheduled", at(500), at(0))],
        [(2, "in progress", at(10), at(12))],
        [(9, "completed", at(0), at(60))],
        [(9, "completed", at(0), at(61))],
    ]
    assert run(batches, schema, flows.no_shows) == [(1, "NO_SHOW")]


def test_no_shows_of_many(run):
    """Candidates that share a group of state keep timers of their own; ids far apart and below 0 too, and rows without an id or a time."""
    schema = "candidate_id long, status string, scheduled_at timestamp, ts timestamp"
    ids = [*range(-3, 2100), 1 << 60, (1 << 60) + 1]
    first = [(i, "scheduled", at(10 + i % 3 * 100), at(0)) for i in ids] + [(None, "scheduled", at(10), at(0)), (5000, "scheduled", None, at(0))]
    moved = [(i, "rescheduled", at(400), at(12)) for i in ids if i % 5 == 0] + [(i, "in progress", at(10), at(12)) for i in ids if i % 7 == 0]
    batches = [first, moved, [(-9, "completed", at(0), at(160))], [(-9, "completed", at(0), at(161))]]
    due = [i for i in ids if i % 5 and i % 7 and i % 3 < 2]
    assert sorted(run(batches, schema, flows.no_shows), key=repr) == sorted([(i, "NO_SHOW") for i in [*due, None]], key=repr)


def test_mail_stages(spark):
    rows = [(1, "interview_invite", "SENT", T0), (2, "other", "sent", T0), (3, "rejection_mail", "failed", T0), (4, None, None, T0)]
    df = spark.createDataFrame(rows, "candidate_id long, email_type string, status string, ts timestamp")
    assert [(r.candidate_id, r.stage) for r in flows.mail_stages(df).collect()] == [(1, "INTERVIEW_SCHEDULED")]
    assert flows.mail_stages(df.filter(F.lit(False))).isEmpty()
