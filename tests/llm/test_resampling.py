"""Importance resampling against plain counts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crewlens.llm import queries, resampling

from . import plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").translate(plain.LOWER))
    return w, [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


def brute(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        w, features = grams(text)
        weight = sum(gain[bucket(g)] for g in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    return [(*r[:4], n) for n, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in [*able[len(drawn) :], *(r for r in out if r[4] < 20)]]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_checksums_put_together():
    rng = random.Random(1)
    sizes = [0, 1, 2, 62, 63, 64, 65, 127, 128, 200, 1000, 70_000]
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in sizes]
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array(sizes)
    crc = resampling.checksums(data, np.cumsum(length) - length, length)
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    head = np.full(len(parts), zlib.crc32(b"head"), np.uint32)
    assert (resampling.shifted(head, length) ^ crc).tolist() == [zlib.crc32(b"head" + p) for p in parts]


def test_features():
    rng = random.Random(3)
    texts = ["", "One", "a-b_c d", "É é日本 x9", "x" * 63 + " " + "y" * 64 + " " + "z" * 300, " tail ", "\x00\x7f", "end", "begin"]
    texts += ["".join(rng.choice("ab C9é\n,日") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    column = pa.array(texts)
    found, owner, words = resampling.features(column.slice(1))
    assert words.tolist() == [len(grams(t)[0]) for t in texts[1:]]
    got = Counter((int(t), int(b)) for some, of in zip(found, owner, strict=True) for b, t in zip(some, of, strict=True))
    assert got == Counter((k, bucket(g)) for k, t in enumerate(texts[1:]) for g in grams(t)[1])


@pytest.mark.parametrize("target", [["w1 w2 w3, W1 w2", None, ""], []])
def test_draw(spark, frame, awkward, target):
    rows = awkward + [(10, awkward[6][1])] * 60
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(frame(rows).repartition(3), items).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert ordered(got) == ordered(brute(rows, target))
    assert resampling.resampled(frame(rows).limit(0), items).collect() == []


def test_numbers_go_on_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ROW_BYTES", 1 << 24)
    rows = spark.range(50).selectExpr("id", "id % 2 as half")
    got = resampling.numbered(rows, [rows["half"].desc(), rows["id"]], 50, "numbers").collect()
    assert {r.id: r.number for r in got} == {i: n for n, i in enumerate([*range(1, 50, 2), *range(0, 50, 2)], 1)}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, d).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert ordered(got) == ordered(brute(rows, target))
