"""Transcripts parsed whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.functions import text as t
from crewlens.plans import catalogue


def test_segments(spark):
    long = "word " * 400 + "end: [x] y"
    whole = f"[00:01] Candidate: {long}\n\n\n [2] bot :  two\nlines \n\nno head here\n\n  \n\n[3] user:"
    got = spark.createDataFrame([(whole,), (None,)], "x string").select(t.transcript_segments(F.col("x")).alias("s")).collect()
    assert [tuple(s) for s in got[0].s] == [("00:01", "Candidate", long), ("2", "bot", "two\nlines"), ("", "Transcript", "no head here"), ("", "Transcript", "[3] user:")]
    assert got[1].s == []


def test_whole_turns(spark, tmp_path):
    texts = ["x" * 3000, "a\n\n[9] user: b", r"C:\new \\n", "tail: " + "y" * 100 + "\n", None, ""]
    rows = [(1, k, "user", x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.said for r in catalogue.queries()["t59_whole_turns"](spark, str(tmp_path)).collect()}
    assert got == {k: f"user: {x}" if x else f"Transcript: [{k}] user:" for k, x in enumerate(texts)}
