"""Hard negatives against all scores, one by one."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewlens.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, own string, score long"


def brute(rows, every=50, k=5, m=3):
    """Rows of the result from (vec_id, embedding, label) in memory."""
    whole = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(whole):
        if i is None or i % every:
            continue
        score = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, w, other in (r for b, r in enumerate(whole) if b != a)]
        ordered = sorted(score, key=lambda r: (-r[0], last(r[1])))
        for p, j, _ in [r for r in ordered if r[2] == label][:k]:
            fit = [r for r in ordered if r[2] != label and 50 * p <= 100 * r[0] <= 95 * p][:m]
            out += [(i, j, n, r[1], p, r[0]) for n, r in enumerate(fit, 1)]
    return out


def ours(frame, **more):
    got = negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0, **more)
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def clustered(n, dims=7, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) + 0.7
    kind = rng.integers(0, labels, n)
    values = centres[kind] + rng.normal(size=(n, dims))
    return [(int(i), [float(x) for x in v], int(c)) for i, v, c in zip(range(n), values, kind, strict=True)]


@pytest.fixture(scope="module")
def made(spark):
    return lambda rows, parts=3: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("block_bytes", [1 << 12, 1 << 22])
def test_all_rows_by_blocks(made, block_bytes):
    rows = clustered(900)
    assert ordered(ours(made(rows), block_bytes=block_bytes)) == ordered(brute(rows))


def test_awkward_vectors(made):
    rows = clustered(260, dims=4, seed=3)
    rows += [(None, [1.0] * 4, 0), (1000, None, 1), (1001, [1.0, None], 1), (1002, [math.nan] * 4, 1), (1003, [math.inf], 2), (1004, [1.0], None)]
    rows += [(50, rows[50][1], rows[50][2])] * 2 + [(100, rows[7][1], rows[100][2]), (150, [2.0, 1.0], 1), (1005, [], 1), (1050, [], 3), (1006, [9.0] * 6, 2)]
    rows += [(2000 + k, rows[0][1], k % 2) for k in range(40)]
    rows += [(1100, [3e6, 1.0], 1), (1101, [3e6], 1), (1102, [2e6], 2), (-50, [0.5] * 4, 0)]
    assert ordered(ours(made(rows))) == ordered(brute(rows))
    assert ours(made([])) == []
    assert ours(made([(0, [1.0], 1)])) == []
    assert ours(made([(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)])) == []


def test_bounds_hold_and_prune(spark, made):
    """Every score lies between its bounds, and few rows are scored exactly."""
    rows = clustered(4000, dims=9, seed=5)
    packed = negatives.blocks(negatives.scaled(made(rows, 1))).collect()
    scored = 0
    for row in packed:
        block = negatives.Block(row.asDict())
        exact = block.exact
        for i in range(0, block.n, 97):
            anchor = block.values[i]
            least, most = block.bounds(anchor, 0, block.n)
            score = exact(anchor, np.arange(block.n))
            assert (least <= score).all() and (score <= most).all()
            block.exact = lambda a, at: (counted.append(len(at)), exact(a, at))[1]
            counted: list[int] = []
            negatives.best_of_label(block, {"label": int(block.labels[i]), "vector": anchor, "vec_id": int(block.ids[i])}, [], 6)
            scored += sum(counted)
            first, last = block.of_label(int(block.labels[i]))
            assert sum(counted) <= 0.5 * (last - first)
    assert scored


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in queries.op11_hard_negatives(spark, d).collect()]
    assert got and sorted(got) == sorted(brute(rows))


def test_ties_at_random(made):
    rng = random.Random(2)
    rows = [(k, [float(rng.randint(-1, 2)) for _ in range(3)], rng.randint(0, 2)) for k in range(400)]
    assert ordered(ours(made(rows, 5), block_bytes=1 << 11)) == ordered(brute(rows))
