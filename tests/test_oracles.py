"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from crewlens.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}".replace("-0", "0") if x == 0 else f"{x:.6g}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_same_rows_as_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, str(DATA))
    names, rows = table(ours.columns, [tuple(r) for r in ours.collect()])
    found = duck.execute(catalogue.oracles()[name])
    assert (names, rows) == table([c[0] for c in found.description], found.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracles()) == {
        "t7_header_breaks", "t9_split_headers", "t10_cleaned", "t18_cleaned_match", "t19_title_bonus", "m9_balanced_total", "e3_block_entries", "e6_line_entries", "o3_total_experience",
        "t42_ranked_names", "t43_gazetteer_places", "e14_parsed_twice", "a35_parse_benchmark", "a36_second_reading_gain", "a37_parse_audit", "t5_without_special_characters",
    }  # fmt: skip  # see test_resume, test_work_history, test_people and test_special_characters
