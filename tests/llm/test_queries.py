"""The numbered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from crewlens.llm import quality, queries, toxicity
from crewlens.llm.labelled import fold

from . import plain
from .test_dedup import check_survivors

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{D}/{table}.parquet')")
    ours, found = queries.queries()[name](spark, D), con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect())) == sorted(found.fetchall())


def test_near_duplicates(spark, rows):
    got = queries.op2_simhash_near_dedup(spark, D).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(plain.near(rows))


def test_contamination(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r["items"] for r in queries.op7_benchmark_decontamination(spark, D).collect()}
    wanted = [(i, Counter_of(p)) for i, p in items]
    for i, text in rows:
        own = {g for g in plain.shingles(text)}
        likely = [(k, p) for k, p in items for s in [wanted_of(wanted, k)] if len(own & s) >= 0.5 * len(s)]
        assert got[i] == ",".join(map(str, sorted(plain.contaminated(text, likely))))


def Counter_of(passage):
    return set(plain.shingles(passage))


def wanted_of(wanted, item):
    return next(s for k, s in wanted if k == item)


@pytest.mark.parametrize(("name", "of", "left_out"), [("op3_toxicity", 3, 1), ("op10_quality_classifier", 4, 2)])
def test_classifiers(spark, rows, name, of, left_out):
    got = queries.queries()[name](spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == left_out)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_toxicity_by_one_text_at_a_time(spark, rows):
    """Scores of the query from dictionaries, a search for segments, and the model's numbers."""
    docs, labels = (spark.read.parquet(f"{D}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 3) == 1)
    token, stem = (dict(zip(map(int, a), b, strict=True)) for a, b in ((model.token, model.token_score), (model.stem, model.stem_score)))
    code = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)

    def score(text):
        words = [re.sub(toxicity.EDGES, "", w) for w in plain.words(text, lower=True)]
        own = [token.get(code(w), stem.get(code(w[: toxicity.STEM]), -toxicity.BELOW)) for w in words]
        own = [-toxicity.BELOW if k and words[k] == words[k - 1] else x for k, x in enumerate(own)]
        sums = [0.0]
        for x in own:
            sums.append(sums[-1] + x)

        def search(a, b):
            """The best run with the leftmost of the shortest, then what is left and right of it."""
            best, low, at = (0.0, 0, 0), sums[a], a
            for j in range(a + 1, b + 1):
                if sums[j] - low > best[0] + 1e-9 or (abs(sums[j] - low - best[0]) <= 1e-9 and best[0] and j - at < best[2] - best[1]):
                    best = (sums[j] - low, at, j)
                if sums[j] <= low:
                    low, at = sums[j], j
            return [] if best[0] <= 0 else [*search(a, best[1]), best[0], *search(best[2], b)]

        found = [model.scale * x - math.log(model.k * max(len(words), 1)) for x in search(0, len(words))]
        together, total = 0.0, 0.0
        for r, x in enumerate(sorted(found, reverse=True), 1):
            total += x
            if total > 0:
                together = max(together, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        z = model.curve[0] * min(max(max(found, default=0.0), 0), 20) + model.curve[1] * min(together, 40.0) + model.curve[2]
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    got = {r.doc_id: r.score for r in queries.op3_toxicity(spark, D).collect()}
    short = [(i, t) for i, t in rows if len(t or "") < 6000]
    assert len(short) > 150
    for i, t in short:
        assert abs(got[i] - score(t)) < 1e-6, i


def test_quality_by_one_text_at_a_time(spark, rows):
    """Scores of the query by a loop over words and plain sums."""
    docs, labels = (spark.read.parquet(f"{D}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels, fold(F.col("doc_id"), 4) == 2)
    mean, spread, w1, b1, w2, b2 = model.layers
    shapes = ((r"\p{Lu}+", "A"), (r"[\p{L}\p{M}]+", "a"), ("[0-9]+", "0"), ("!+", "!"), ("#+", "#"), (r"\*+", "*"), (r"\$+", "$"), ("%+", "%"), ("&+", "&"))
    code = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)

    def score(text):
        words, pooled = plain.words(text), np.zeros(2 * quality.DIM)
        for k, w in enumerate(words):
            shape = w
            for pattern, to in shapes:
                shape = regex.sub(pattern, to, shape)
            h = code(shape) ^ (int(quality.REPEAT) if k and words[k - 1] == w else 0)
            first = int(quality.mix64(np.array([h], np.uint64))[0]) % quality.ROWS
            second = code(w.translate(plain.LOWER)) % quality.ROWS
            pooled += np.concatenate([model.vectors[first], model.vectors[second + quality.ROWS]])
        x = (pooled / max(len(words), 1) - mean) / spread
        return 1 / (1 + math.exp(-float(np.tanh(x @ w1 + b1) @ w2 + b2[0]) / model.temperature))

    got = {r.doc_id: r.score for r in queries.op10_quality_classifier(spark, D).collect()}
    for i, t in [(i, t) for i, t in rows if len(t or "") < 6000]:
        assert abs(got[i] - score(t)) < 1e-3, i


def test_token_counts_and_packing_by_name(spark, rows):
    from crewlens.llm import token_files

    encode = token_files.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).encode_ordinary
    assert {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, D).collect()} == {i: len(encode(t or "")) for i, t in rows}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = defaultdict(int)
    for p in queries.op9_packing(spark, D).collect():
        got[p.doc_id] += p.length
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}


def test_language_model_by_name(spark, rows):
    got = queries.op5_lm_scoring(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_stages_take_awkward_tables(spark, frame, awkward):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table through all stages."""
    for rows in (awkward, []):
        docs = frame(rows) if rows else frame(awkward).limit(0)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            docs = spark.createDataFrame(stage(spark, docs, D).collect(), docs.schema)
            assert docs.columns == columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
        assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    first = corpus_pipeline.STAGES[0][1]
    assert first(spark, frame(awkward).limit(0), D).count() == 0
    assert first(spark, frame(awkward), D).columns == columns


def test_pipeline(spark, rows):
    """Each stage against a plain version of what the stage before kept, and run() against the stages."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, None
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, D).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality_classifier":
            all_docs = spark.read.parquet(f"{D}/documents.parquet")
            model = quality.fit(all_docs, spark.read.parquet(f"{D}/labels.parquet"), fold(F.col("doc_id"), 4) == 2)
            good = {r.doc_id for r in quality.quality(all_docs, model).collect() if r.score >= 0.5}
            assert {i for i, _ in kept[name]} == good
        elif name == "line_dedup":
            assert sorted(kept[name]) == sorted((i, t) for i, _, _, t, _ in plain.lines(before))
        elif name == "simhash_near_dedup":
            assert len(check_survivors(before, kept[name])) <= 1
        else:
            assert set(kept[name]) <= set(before)
        before = kept[name]
    tokens = defaultdict(int)
    for p in corpus_pipeline.run(spark, D).collect():
        tokens[p.doc_id] += p.length
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before}
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
