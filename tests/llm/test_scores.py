"""Rules, toxicity, quality, the language model, token files and packing."""

from __future__ import annotations

import base64
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crewlens.llm import labelled, language_model, packing, quality, rules, token_files, toxicity

from . import plain

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def auc(y, s):
    order = pd.Series(s).rank().to_numpy()  # equal scores share their rank
    y = np.asarray(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_rules_measure_like_a_plain_version(frame, awkward):
    got = rules.ledger(frame(awkward)).collect()
    want = [(i, *plain.quality(t)) for i, t in awkward]
    assert sorted([(r.doc_id, *[r[m] for m in MEASURES]) for r in got], key=repr) == sorted(want, key=repr)


def test_policies_read_the_mask(frame, awkward):
    book = rules.ledger(frame(awkward + [(90, "# $ % " * 30), (91, "fine words here " + " ".join(f"z{k}" for k in range(60)))]))
    rows = {r.doc_id: r for r in rules.verdict(book, "strict", 2).collect()}
    assert rows[91].kept and not rows[90].kept and not rows[2].kept
    table = {r.rule: r for r in rules.ablation(book, "strict", 2).collect()}
    failed = [r.failed for r in book.collect()]
    for k, rule in enumerate(rules.RULES):
        assert table[rule].rejected == sum(m >> k & 1 for m in failed)
        assert table[rule].rejected_alone == sum(m == 1 << k for m in failed)
        assert table[rule].kept_without == sum(m & ~(1 << k) == 0 for m in failed)


def test_rules_run_no_python(frame, awkward, capsys):
    rules.ledger(frame(awkward)).explain()
    assert "Python" not in capsys.readouterr().out


def test_fold(spark):
    ids = [1, 22, 12345, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(labelled.fold(F.col("doc_id"), 4).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(("" if i is None else str(i)).encode()) % 4 for i in ids]


def test_maximal_segments_against_search():
    rng = np.random.default_rng(0)
    for _ in range(50):
        score = rng.choice([-1.0, -0.5, 0.7, 2.0], 12)
        sums = np.concatenate([[0.0], np.cumsum(score)])
        got = toxicity.maximal_segments(np.flatnonzero(score > 0), sums)

        def search(a, b):
            best = max(((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 1e-9:
                return []
            _, _, _, i, j = best
            return [*search(a, i), (i, j), *search(j, b)]

        assert [(i, j) for i, j, _ in got] == search(0, 12)


def labelled_texts(n, hot, rng):
    rows, marks = [], []
    for k in range(n):
        y = k % 3 == 0
        body = [f"u{rng.randint(0, 300)}" for _ in range(rng.randint(20, 120))]
        if y:
            at = rng.randrange(len(body))
            body[at:at] = [rng.choice(hot) for _ in range(4)]
        rows.append((k, " ".join(body)))
        marks.append((k, 0 if y else 1, int(y)))
    return rows, marks


@pytest.fixture(scope="module")
def marked():
    return labelled_texts(600, ["vile", "scum!", "Moron,", "trash"], random.Random(3))


def test_toxicity_is_found_in_held_out_rows(frame, spark, marked):
    rows, marks = marked
    docs, labels = frame(rows + [(900, None), (901, "")]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, labelled.fold(F.col("doc_id"), 3) == 1)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [k for k, _, _ in marks if zlib.crc32(str(k).encode()) % 3 == 1]
    assert auc([marks[k][2] for k in held], [got[k].score for k in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score < 0.5
    start, end, _ = next(got[k].passages[0] for k in held if marks[k][2] and got[k].passages)
    assert end > start


def test_no_labels_no_verdict(frame, spark):
    docs, none = frame([(1, "a"), (None, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none, F.lit(False)) is None
    assert quality.fit(docs, none, F.lit(False)) is None
    assert {r.score for r in toxicity.toxicity(docs, None).collect()} == {0.0}
    assert {r.score for r in quality.quality(docs, None).collect()} == {0.5}


def test_quality_is_told_in_held_out_rows(frame, spark, marked):
    rows, marks = marked
    docs, labels = frame(rows + [(900, None), (901, "")]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, labelled.fold(F.col("doc_id"), 4) == 2)
    got = {r.doc_id: r.score for r in quality.quality(docs, model).collect()}
    held = [k for k, _, _ in marks if zlib.crc32(str(k).encode()) % 4 == 2]
    assert auc([marks[k][1] for k in held], [got[k] for k in held]) > 0.9
    assert got[900] == got[901]
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= 0.5}


def test_language_model(frame, awkward):
    rng = random.Random(5)
    rows = awkward + [(1000 + k, " ".join(rng.choice(["the cat", "a dog", "the Dog", "a cat"]) for _ in range(30))) for k in range(60)]
    got = sorted(language_model.lm_scores(frame(rows), labelled.fold(F.col("doc_id"), 10) == 0).collect(), key=repr)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(t for i, x in rows if not held(i) for t in [*plain.words(x, lower=True), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x in rows:
        t = [*plain.words(x, lower=True), "\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == sorted(want, key=repr)
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_network_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    two, one = rng.integers(0, 11, (2, 4000))
    drawn = np.stack([two, one, np.where(two < 3, 7, one % 10)])
    net = language_model.Network(np.full(10, 0.1)).train(drawn, epochs=60, batch=64)
    contexts = np.array([(a, b, c) for a in range(11) for b in range(11) for c in range(10)]).T
    p = 10.0 ** net.log10(*contexts).reshape(121, 10)
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    assert net.log10(*drawn).mean() > -0.3


def test_network_learns_from_all_positions(frame, monkeypatch):
    """Where the draw is only a part, the network goes on over all others, in several tasks, however the rows lie."""
    for name, value in (("DRAWS", 300), ("DRAWS_A_LEAF", 1), ("SHARD", 4000), ("HELD", 512), ("STEP", 128)):
        monkeypatch.setattr(language_model, name, value)
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["one two three four", "five six seven eight", "nine ten six two"]) for _ in range(25))
    docs = frame([(k, text()) for k in range(120)] + [(500, None), (501, ""), (502, "one")])
    held = labelled.fold(F.col("doc_id"), 10) == 0
    read = language_model.id_and_text(docs).withColumn("held", held)
    corpus = language_model.summed(language_model.count_tokens(read))
    rate = (language_model.DRAWS + language_model.DRAWS_A_LEAF * corpus.leaves) / corpus.total
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    part = language_model.drawn(read, shared, corpus.names, rate)
    start = language_model.Network(corpus.share).train(part)
    assert part.shape[1] < corpus.total / 10 and corpus.total > 2 * language_model.SHARD
    net = language_model.trained(read, shared, rate)
    assert net.seen == corpus.total
    everything = language_model.drawn(read, shared, corpus.names, 1.0)
    assert net.log10(*everything).mean() > start.log10(*everything).mean() + 0.05
    scores = [{r.doc_id: r.score for r in language_model.lm_scores(x, held).collect()} for x in (docs, docs.repartition(7, "text"))]
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-6


def test_scores_against_a_plain_version(frame, awkward):
    """The model's probability of each token, one at a time and from dense softmax, with all and with few common tokens."""
    rng = random.Random(5)
    rows = awkward[:20] + [(1000 + k, " ".join(rng.choice(["the cat", "a dog", "the Dog", "a cat", f"z{rng.randint(0, 99)}"]) for _ in range(30))) for k in range(40)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda x: [*plain.words(x, lower=True), "\n"]
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    spark_rows = frame(rows)
    read = language_model.id_and_text(spark_rows).withColumn("held", labelled.fold(F.col("doc_id"), 10) == 0)
    for common in (language_model.COMMON, 100):
        corpus = language_model.summed(language_model.count_tokens(read), common)
        assert (corpus.total, corpus.distinct) == (n, v)
        shared = spark_rows.sparkSession.sparkContext.broadcast(corpus)
        rate = (language_model.DRAWS + language_model.DRAWS_A_LEAF * corpus.leaves) / corpus.total
        net = language_model.Network(corpus.share).train(language_model.drawn(read, shared, corpus.names, rate))
        h = {w: np.uint64(language_model.END_HASH if w == "\n" else language_model.string_hashes(pa.array([w]))[0]) for x in rows for w in tokens(x[1])}
        tail = {w: 0 if w == "\n" else int(language_model._tail_hash(pa.array([w]))[0]) for w in h}
        named = {int(a): int(b) for a, b in zip(corpus.known, corpus.leaf, strict=True) if b >= 0}
        leaf = {w: named.get(int(h[w]), corpus.leaves + tail[w] % corpus.tails) for w in h}
        p = {w: (counts[w] + 0.1) / corpus.below for w in h}
        share = defaultdict(float)
        for w in counts:
            share[leaf[w]] += p[w]
        p0 = 0.1 / corpus.below

        def log_p(two, one, w):
            hid = net.hidden(np.array([two]), np.array([one]))[0].astype(float)
            z = net.w["class"] @ hid + net.w["class_bias"][:, 0]
            c = leaf[w] // net.width
            some = slice(c * net.width, (c + 1) * net.width)
            y = net.w["leaf"][some] @ hid + net.w["leaf_bias"][some, 0]
            soft = lambda a, k: a[k] - np.log(np.exp(a).sum())
            return (soft(z, c) + soft(y, leaf[w] - c * net.width)) / np.log(10) + math.log10((1 - p0) * p[w] / share[leaf[w]])

        want = []
        for i, x in rows:
            ids, total = [corpus.names, corpus.names], 0.0
            for w in tokens(x):
                total += log_p(ids[-2], ids[-1], w) if counts[w] else math.log10(p0)
                ids.append(leaf[w])
            want.append((repr(i), round(total, 3)))
        got = language_model.lm_scores(spark_rows, labelled.fold(F.col("doc_id"), 10) == 0, common).collect()
        for (a, x), (b, y) in zip(sorted((repr(r.doc_id), r.score) for r in got), sorted(want), strict=True):
            assert a == b and abs(x - y) < 0.01 + 1e-4 * abs(y)
        # all known tokens and the unknown share one
        context = (leaf["the"], leaf["cat"])
        assert abs(sum(10 ** log_p(*context, w) for w in counts) + p0 - 1) < 1e-4


def test_token_counts(frame, awkward):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode = token_files.encoding(path).encode_ordinary
    got = token_files.token_counts(frame(awkward), path, block=64).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((i, len(encode(t or ""))) for i, t in awkward), key=repr)
    assert token_files.token_counts(frame([(1, "a")]).limit(0), path).isEmpty()


def test_pattern_is_that_of_the_vocabulary():
    assert token_files.PATTERN == public_tokenizers.PATTERN
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(ranks, "rb") as lines:
        assert max(int(x.split()[1]) for x in lines) < token_files.END
    assert base64.b64decode("") == b""


def test_scan_stitches_documents_over_blocks(spark):
    ids = np.array([7, 7, 9, 9, 7, 7, 7, 7, 7, 9, 7], "<u2")
    for cut in (0, 1, 4, 6, 11):
        parts = [(0, 0, bytearray(ids[:cut].tobytes())), (0, 1, bytearray(ids[cut:].tobytes())), (1, 0, bytearray(b""))]
        files = spark.createDataFrame(parts, "stream long, part long, content binary")
        for block in (1, 2, 3, 100):
            got = token_files.scan_token_files(files, end=9, block=block).orderBy("ordinal").collect()
            assert [(r.ordinal, r.n_tokens) for r in got] == [(0, 2), (1, 0), (2, 5), (3, 1)]


@pytest.mark.parametrize(("most", "size"), [("7", 1 << 26), ("50", 20_000)])
def test_token_counts_over_many_files(spark, monkeypatch, most, size):
    """Files may break anywhere, by documents or bytes; the two kinds need not break at the same document."""
    monkeypatch.setattr(token_files, "FILE_BYTES", size)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode = token_files.encoding(path).encode_ordinary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files, token_files.FILE_DOCS = token_files.FILE_DOCS, int(most)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        got = {r.doc_id: r.n_tokens for r in token_files.token_counts(docs, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        token_files.FILE_DOCS = files
    assert got == {r.doc_id: len(encode(r.text or "")) for r in docs.collect()}


def test_packing(frame, awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = awkward + [(70, "it's DON'T a.b,c 12,5 (x)!? naïve ﬁ <|endoftext|> x y 日本語 é")]
    pieces = packing.packed(frame(rows), path, size=64).collect()
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    want, got = defaultdict(list), defaultdict(list)
    for i, t in rows:
        want[i].append(encode(t))
    for p in pieces:
        got[p.doc_id].append(p)
    assert set(want) == set(got)
    for i, texts in want.items():
        assert sum(p.length for p in got[i]) == sum(map(len, texts))
        for p in got[i]:
            fits = [x for x in texts if len(x) == p.doc_tokens]
            assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in fits)
    full = defaultdict(list)
    for p in pieces:
        full[p.sequence_id].append(p)
    for some in full.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or at & (at - 1) == 0
    assert packing.packed(frame([(1, "a")]).limit(0), path).isEmpty()


def test_hilbert_neighbours_touch():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_word_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    one = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = pa.array(["alpha beta gamma, delta. alpha", None, "beta"]).fill_null("")
    ids, offsets = one.texts(text)
    again, _ = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).texts(text)
    assert ids.tolist() == again.tolist() and len(offsets) == 4


def test_language_model_without_rows_or_training(frame):
    assert language_model.lm_scores(frame([(1, "a")]).limit(0), F.lit(False)).isEmpty()
    (only,) = language_model.lm_scores(frame([(1, "a b")]), F.lit(True)).collect()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.held_out) == (3, 0, 0, True)
    assert only.base_score == only.score == pytest.approx(0.0)


@pytest.fixture(scope="module")
def long_and_repeated(marked):
    """One very long text, rows that occur twice, nulls and empties among the marked texts."""
    rows, _ = marked
    long = " ".join(f"u{k % 301} vile" if k % 97 == 0 else f"u{k % 301}" for k in range(120_000))
    return [*rows[:20], *rows[:20], (5000, long), (5000, long), (5001, None), (5001, ""), (None, "a b"), (None, None)]


def test_rules_of_long_repeated_and_no_texts(frame, long_and_repeated):
    rows = [(i, t if i != 5000 else t[:400_000]) for i, t in long_and_repeated]
    got = rules.ledger(frame(rows)).collect()
    want = [(i, *plain.quality(t)) for i, t in rows]
    assert sorted([(r.doc_id, *[r[m] for m in MEASURES]) for r in got], key=repr) == sorted(want, key=repr)
    none = frame([(1, "a")]).limit(0)
    assert rules.ledger(none).isEmpty() and rules.verdict(rules.ledger(none), "strict", 2).isEmpty()
    assert {r.rejected for r in rules.ablation(rules.ledger(none), "strict", 2).collect()} <= {0}


def test_sole_rule(frame):
    book = rules.ledger(frame([(1, "too short"), (2, "# $ % " * 30), (3, " ".join(f"fine{k}" for k in range(60)))]))
    got = {r.doc_id: r.sole for r in book.select("doc_id", rules.sole_rule("strict", 2).alias("sole")).collect()}
    assert got == {1: "few_words", 2: None, 3: None}


@pytest.mark.parametrize("which", ["toxicity", "quality"])
def test_classifiers_of_long_repeated_and_no_texts(frame, spark, marked, long_and_repeated, which):
    module = {"toxicity": toxicity, "quality": quality}[which]
    rows, marks = marked
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = module.fit(frame(rows), labels, F.lit(False))
    score = getattr(module, which)
    got = score(frame(long_and_repeated), model).collect()
    assert len(got) == len(long_and_repeated)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(round(r.score, 6))
    assert all(len(x) == 1 for i, x in by.items() if i is not None) and all(0 <= x <= 1 for s in by.values() for x in s)
    assert score(frame(rows).limit(0), model).isEmpty()
    assert module.fit(frame(rows).limit(0), labels, F.lit(False)) is None


def test_language_model_and_tokens_of_long_and_repeated_texts(frame, long_and_repeated):
    got = language_model.lm_scores(frame(long_and_repeated), F.col("doc_id") == 3).collect()
    assert len(got) == len(long_and_repeated)
    both = [r for r in got if r.doc_id == 5000]
    assert both[0].score == pytest.approx(both[1].score) and both[0].n_tokens == len(plain.words(long_and_repeated[40][1])) + 1


@pytest.mark.parametrize("seed", range(5))
def test_segments_like_recursion(seed):
    """The stack gives the segments that taking out the best run again and again gives."""
    rng = np.random.default_rng(seed)
    score = rng.integers(-3, 4, 400).astype(float)
    sums = np.concatenate([[0.0], np.cumsum(score)])

    def search(a, b):
        best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*search(a, i), best[0], *search(j, b)]

    got = toxicity.maximal_segments(np.flatnonzero(score > 0), sums)
    assert sorted(x for *_, x in got) == sorted(search(0, 400))


def test_segments_take_linear_time():
    """A quarter of a million positive tokens apart from each other, while sums fall and while they rise."""
    import time

    n = 500_000
    for step in (-1.5, -1.0, -0.5):
        score = np.tile([1.0, step], n // 2)
        began = time.process_time()
        toxicity.maximal_segments(np.flatnonzero(score > 0), np.concatenate([[0.0], np.cumsum(score)]))
        assert time.process_time() - began < 20
