"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, block int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) with further columns whose names operators might use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "r", 3) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty texts, repeated rows, ties, one long text, other scripts."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "x" * 50]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, common = line(20), line(8)
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t\n"), (4, "One"), (5, "a b c\x0bd")]
    rows += [(10 + k, "\n".join([line(12), common, shared if k % 3 == 0 else line(9), common.upper() + " "])) for k in range(30)]
    rows += [(10, rows[6][1]), (10, rows[6][1]), (None, rows[7][1]), (50, rows[8][1]), (51, rows[8][1])]
    rows += [(60, "\n".join(line(rng.randint(1, 30)) for _ in range(2500)))]
    return rows
