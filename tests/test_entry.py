"""The driver's entry points."""

from __future__ import annotations


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ordinal", "stage", "count", "percentage"]
    assert set(e.oracle_sql()) <= set(e.queries())
