"""Near-duplicates, repeated passages and lines, benchmark passages, against plain versions."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from crewlens.llm import decontaminate, lines, shared, similar, simhash, substrings, texts

from . import plain


def by(rows):
    return sorted(map(tuple, rows), key=repr)


def test_xxh64_of_many_lengths():
    words = ["".join(chr(97 + (k * j) % 26) for j in range(k)) + "é" * (k % 2) for k in range(100)]
    got = texts.string_hashes(pa.array(words))
    assert got.tolist() == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_line_dedup(frame, awkward):
    got = lines.line_bitmaps(frame(awkward)).collect()
    assert by((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == by((i, n, d, plain.sha(t)) for i, n, d, t, _ in plain.lines(awkward))
    assert by((r.doc_id, lines.unpack_bitmap(r.keep_bitmap)) for r in got) == by((i, k) for i, *_, k in plain.lines(awkward))


def test_line_dedup_keeps_columns(frame, awkward):
    docs = frame(awkward)
    got = lines.without_repeated_lines(docs)
    assert got.columns == docs.columns
    assert by((r.doc_id, r.text or "", r.row, r.block) for r in got.collect()) == by((i, t, "r", 3) for i, _, _, t, _ in plain.lines(awkward))


@pytest.mark.parametrize("window", [13, 3])
def test_substring_dedup(frame, awkward, window):
    got = substrings.substring_dedup(frame(awkward), window)
    assert by((r.doc_id, r.n_words, r.n_removed, plain.sha(r.kept_text)) for r in got.collect()) == by(plain.substrings(awkward, window))


def test_near_duplicates(frame, awkward):
    rng = random.Random(1)
    base = [f"v{rng.randint(0, 500)}" for _ in range(200)]
    copies = [(100 + k, " ".join(base[: 200 - k] + ["end"] * k)) for k in range(6)]
    rows = awkward + copies
    got = simhash.near_duplicates(frame(rows))
    assert by((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == by(plain.near(rows))


def test_long_lists_lose_no_link(frame, spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            prints.add(int(b) ^ sum(1 << int(x) for x in flips))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.components(simhash.edges(spark.createDataFrame(signed, "f0 long"), list_limit=8)).collect()
    root = {r.u: r.root for r in links}
    got = {}
    for (p,) in signed:
        got.setdefault(root.get(p, p), set()).add(p)
    want, left = [], {p for (p,) in signed}
    while left:
        piece, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            piece.add(x)
            close = {y for y in left if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 4}
            left -= close
            todo += close
        want.append(piece)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "u long, v long")
    got = {r.u: r.root for r in simhash.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 51)}, 101: 100}


def test_one_of_each_group(frame, awkward):
    docs = frame(awkward)
    kept = simhash.one_of_each_group(docs, simhash.NEAR)
    wanted = sorted({plain.key_of(c) for _, _, c in plain.near(awkward)})
    assert kept.columns == docs.columns
    assert sorted(plain.key_of(r.doc_id) for r in kept.collect()) == wanted


def test_one_of_each_group_drops_rows_not_ids(frame):
    rows = [(1, "a text that is here twice in all"), (2, "a text that is here twice in all"), (2, "quite another text with the same id")]
    got = simhash.one_of_each_group(frame(rows), simhash.NEAR).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([rows[0], rows[2]])


def test_the_largest_id_is_an_id(frame):
    rows = [(plain.LARGEST, "a text that is here three times in all\nwith a second line"), (None, "a text that is here three times in all\nwith a second line")]
    assert {r.component_id for r in simhash.near_duplicates(frame(rows)).collect()} == {plain.LARGEST}
    assert {r.doc_id: r.n_dropped for r in lines.line_bitmaps(frame(rows)).collect()} == {plain.LARGEST: 0, None: 2}
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(frame(rows), 3).collect()}
    assert got == {plain.LARGEST: 0, None: 13}


def sets_of(text):
    return frozenset(plain.shingles(text)) or frozenset([""])


def similarity(a, b):
    return len(a & b) / len(a | b)


def check_survivors(before, kept):
    """What goes is 0.8 similar to something that stays; next to nothing that stays is 0.8 similar to something else that stays."""
    stay = [(i, sets_of(t)) for i, t in kept]
    key = {(i, t or "") for i, t in kept}
    index: dict = {}
    for k, (_, own) in enumerate(stay):
        for g in own:
            index.setdefault(g, set()).add(k)
    near = lambda own: {k for g in own for k in index.get(g, ())}
    for i, t in before:
        if (i, t or "") not in key:
            own = sets_of(t)
            assert any(similarity(own, stay[k][1]) >= 0.8 for k in near(own)), i
    return [(stay[a][0], stay[b][0]) for a in range(len(stay)) for b in near(stay[a][1]) if b < a and similarity(stay[a][1], stay[b][1]) >= 0.8]


def edited(rng, size, changes):
    base = [f"v{rng.randint(0, 5000)}" for _ in range(size)]
    copy = base[:]
    for p in rng.sample(range(size), changes):
        copy[p] = "edited"
    return " ".join(base), " ".join(copy)


def test_similar_groups(frame, awkward):
    """Close pairs, a group of many near copies, a chain, null and repeated ids."""
    rng = random.Random(6)
    rows = list(awkward)
    for k in range(60):
        rows += zip((1000 + 2 * k, 1001 + 2 * k), edited(rng, 300, 1 + k % 3), strict=True)
    many = [f"m{j}" for j in range(200)]
    rows += [(3000 + k, " ".join(many[:k] + ["x"] + many[k + 1 :])) for k in range(100)]
    chain = [f"c{j}" for j in range(420)]
    rows += [(5000 + k, " ".join(chain[10 * k : 10 * k + 200])) for k in range(20)]  # each like the next, not like the one after many
    rows += [(4000, "one two three"), (4000, "ONE two three"), (4001, "")]
    rng.shuffle(rows)
    docs = frame(rows)
    got = similar.one_of_each_similar(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(check_survivors(rows, kept)) <= 2
    assert sum(3000 <= (i or 0) < 4000 for i, _ in kept) == 1
    assert sum(i == 4000 for i, _ in kept) == 1
    assert 4 <= sum(5000 <= (i or 0) for i, _ in kept) < 15
    assert similar.one_of_each_similar(docs.limit(0)).collect() == []


def test_long_lists_of_similar_texts(frame):
    """Lists beyond the limit are split, and nothing is lost."""
    many = [f"m{j}" for j in range(150)]
    rows = [(k, " ".join(many[:k] + ["x"] + many[k + 1 :])) for k in range(120)]
    kept = [(r.doc_id, r.text) for r in similar.one_of_each_similar(frame(rows), list_limit=16).collect()]
    assert kept == [rows[0]]


def test_similar_recall(frame):
    """The share of pairs that are found, by their similarity: 0.9 and more in each band from 0.8 on, and nothing below."""
    rng = random.Random(7)
    rows, alike = [], {}
    for k in range(1000):
        pair = edited(rng, 300 if k % 2 else 700, 1 + k % (14 if k % 2 else 33))
        rows += zip((2 * k, 2 * k + 1), pair, strict=True)
        alike[2 * k + 1] = similarity(*map(sets_of, pair))
    left = {r.doc_id for r in similar.one_of_each_similar(frame(rows)).collect()}
    assert all(i in left for i, s in alike.items() if s < 0.8)
    band = {low: [i not in left for i, s in alike.items() if low <= s < low + 0.05] for low in (0.8, 0.85, 0.9, 0.95)}
    print({low: (len(x), round(float(np.mean(x)), 3)) for low, x in band.items()})
    assert all(len(x) >= 50 and np.mean(x) >= 0.9 for x in band.values())


def test_similar_loses_no_link(frame):
    """Every pair of a similarity of 0.8 or more is found, also just there and of short texts; no two that stay are alike."""
    rng = random.Random(17)
    rows, alike = [], {}
    for k in range(900):
        n = (12, 40, 150, 300)[k % 4]
        pair = edited(rng, n, 1 + k % max(2, n // 44))
        rows += zip((2 * k, 2 * k + 1), pair, strict=True)
        alike[2 * k + 1] = similarity(*map(sets_of, pair))
    left = {r.doc_id for r in similar.one_of_each_similar(frame(rows)).collect()}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) >= 50
    assert {i for i in alike if i in left} == {i for i, x in alike.items() if x < similar.LEAST - 1e-9}


def test_alike_sets_share_a_posting():
    """By construction: as many shingles changed as may be, of sets of all sizes; lists beyond the limit lose no pair."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 333, 1000]:
        for gone in range(n + 1):
            added = int((n - gone) / similar.LEAST + 1e-9) - n
            if added < 0:
                break
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, added, dtype=np.uint64)]))
            keys = [set(similar._signed(x, np.array([1]), np.array([len(x)]))[0].tolist()) for x in (a, b)]
            assert keys[0] & keys[1], (n, gone, added)


def test_alike_sets_share_enough_postings(spark):
    """By construction, as above: of no pair at the limit are fewer postings shared than are asked for."""
    rng, rows = np.random.default_rng(3), []
    for n in [*range(1, 60), 100, 333, 1000]:
        for gone in range(n + 1):
            added = int((n - gone) / similar.LEAST + 1e-9) - n
            if added < 0:
                break
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            sets = a, np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, added, dtype=np.uint64)]))
            told, keys = [], []
            for x in sets:
                size = np.array([len(x)])
                by = [set(similar._posted(x, size, up)[0].tolist()) for up in (0, 1)]
                told.append((len(x), int(similar._classes(size)[0]), len(by[0]), len(by[1])))
                keys.append(by[0] | by[1])
            rows.append((*told, len(keys[0] & keys[1])))
    told = "struct<size:long,class:long,own:long,next:long>"
    made = spark.createDataFrame(rows, f"a {told}, b {told}, shared long")
    assert made.filter(similar._enough(F.col("a"), F.col("b"), F.col("shared"))).count() == len(rows)


def test_few_shared_postings_are_not_compared(frame, monkeypatch):
    """Unlike texts with a long passage in common are not sent to the comparison; alike ones are."""
    rng = random.Random(8)
    word = lambda: f"u{rng.randint(0, 50000)}"
    passage = " ".join(word() for _ in range(60))
    rows = [(k, " ".join([passage, *(word() for _ in range(200))])) for k in range(12)]
    rows.append((100, rows[3][1] + " more"))
    docs, asked = frame(rows), []
    compared = similar.alike
    monkeypatch.setattr(similar, "alike", lambda pairs, *x: asked.append(pairs.count()) or compared(pairs, *x))
    first = similar.first_rows(similar.fingerprints(docs, similar.RULE))
    links, _, _ = similar.exact_links(docs, first.select("node", "k", F.col("k").alias("order")))
    assert links.count() == 1 and asked == [1]


def test_links_of_long_lists(frame, monkeypatch):
    monkeypatch.setattr(similar, "LONG", 4)
    many = [f"m{j}" for j in range(150)]
    docs = frame([(k, " ".join(many[:k] + ["x"] + many[k + 1 :])) for k in range(40)])
    first = similar.first_rows(similar.fingerprints(docs, similar.RULE))
    links, _, _ = similar.exact_links(docs, first.select("node", "k", F.col("k").alias("order")), list_limit=8)
    assert links.count() == 40 * 39 // 2


def test_similar_leaves_no_shuffles_and_no_large_tables(spark, frame, awkward):
    """Shuffle files go with the action that made them, and tables of sets and pairs once they are replaced."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folder = Path(shared.shared_folder(spark).removeprefix("file:"))

    def held():
        found = disk.getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}, {p.name for p in folder.iterdir()}

    setting = spark.conf.get(shared.CLEANUP)
    before = held()
    kept = similar.one_of_each_similar(frame(awkward + [(2000 + k, t) for k in range(20) for t in edited(random.Random(k), 60, 1)]))
    for _ in range(50):  # files are deleted in the background
        shuffles, tables = (b - a for a, b in zip(before, held(), strict=True))
        if not shuffles:
            break
        time.sleep(0.1)
    assert not shuffles
    assert not {t for t in tables if t.split("-")[0] in ("half", "sets", "shingles", "met", "pairs", "left", "right")}
    assert spark.conf.get(shared.CLEANUP) == setting
    assert 20 <= sum(r.doc_id is not None and r.doc_id >= 2000 for r in kept.collect()) < 40


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(9)
    word = lambda: f"q{rng.randint(0, 400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 12, 30, 60])))) for k in range(8)] + [(8, None), (9, ""), (7, "again " * 12)]
    rows = [(None, None), (1, ""), (2, "short")]
    for k in range(60):
        body = [word() for _ in range(rng.randint(5, 150))]
        passage = (items[k % 8][1] or "").split()
        if k % 2 and passage:
            for _ in range(k // 20):
                passage[rng.randrange(len(passage))] = word()
            body[len(body) // 2 : len(body) // 2] = passage
        rows.append((10 + k, " ".join(body).upper() if k % 5 == 0 else " ".join(body)))
    return rows, items


@pytest.mark.parametrize("part_bytes", [1 << 24, 3000])
def test_contamination(frame, spark, leaks, part_bytes):
    rows, items = leaks
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in decontaminate.contamination(frame(rows), bench, part_bytes=part_bytes).collect()}
    assert got == {i: plain.contaminated(t, items) for i, t in rows}
    kept = decontaminate.clean(frame(rows), bench, part_bytes=part_bytes)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, t in rows if not plain.contaminated(t, items))


def test_blocks_find_all_within_the_radius():
    """Fingerprints within the radius always meet; items that meet by chance are few."""
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 63, (500, decontaminate.PRINT_WORDS), dtype=np.uint64)
    items = decontaminate.Items(list(range(500)), [np.arange(k * 9, k * 9 + 9, dtype=np.uint64) for k in range(500)], 0.8)
    values = decontaminate._block_values(prints)
    items.lists = []
    for v in values.T:
        key = 9 << 16 | v
        order = np.argsort(key, kind="stable")
        items.lists.append((key[order], order))
    near = prints.copy()
    for row in near:
        for bit in rng.choice(256, decontaminate.RADIUS, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    window, item = items.met(np.full(500, 9), near)
    assert set(zip(range(500), range(500))) <= set(zip(window.tolist(), item.tolist(), strict=True))
    assert len(items.met(np.full(500, 8), near)[0]) == 0
    strange = rng.integers(0, 1 << 63, (500, decontaminate.PRINT_WORDS), dtype=np.uint64)
    share = len(items.met(np.full(500, 9), strange)[0]) / 500**2
    print("met by chance", share)
    assert share < 0.05


def test_nothing_in_nothing_out(frame, spark):
    none = frame([(1, "a")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert lines.line_bitmaps(none).isEmpty()
    assert lines.without_repeated_lines(none).isEmpty()
    assert substrings.substring_dedup(none).isEmpty()
    assert simhash.near_duplicates(none).isEmpty()
    assert decontaminate.contamination(none, bench).isEmpty()
    assert decontaminate.clean(frame([(1, "a"), (None, None)]), bench).count() == 2


def test_passages_in_long_and_repeated_texts(frame, spark):
    item = " ".join(f"b{k}" for k in range(40))
    long = " ".join([f"x{k}" for k in range(60_000)] + [item] + [f"y{k}" for k in range(20_000)])
    rows = [(1, long), (1, long), (2, item), (2, item), (3, long.replace("b2", "c2")), (None, item)]
    bench = spark.createDataFrame([(7, item), (7, item), (8, item), (None, None)], "item_id long, text string")
    got = decontaminate.contamination(frame(rows), bench).collect()
    assert sorted((r.doc_id or 0, r.contaminated, tuple(r["items"])) for r in got) == [(0, True, (7, 8)), (1, True, (7, 8)), (1, True, (7, 8)), (2, True, (7, 8)), (2, True, (7, 8)), (3, False, ())]


def test_lines_that_cross_batches(spark):
    """A key whose rows come in many batches has one first document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, "the same long line in all\nown line number %d here" % k) for k in range(40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = {r.doc_id: r.n_dropped for r in lines.line_bitmaps(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: int(k > 0) for k in range(40)}


def test_passages_in_long_texts_of_one_word(frame, spark):
    """Memory follows the text's length: every window of the text holds the item's shingles."""
    import tracemalloc

    item = " ".join(["again"] * 400)
    rows = [(1, " ".join(["again"] * 60_000)), (2, " ".join(["again"] * 399 + ["more"])), (3, "again " * 30 + "x y z")]
    bench = spark.createDataFrame([(7, item), (8, "again again again again again")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(frame(rows), bench).collect()}
    assert got == {i: sorted(plain.contaminated(t, [(7, item), (8, "again again again again again")])) for i, t in rows[1:]} | {1: [7, 8]}
    shingles, edges = decontaminate._shingles(pa.array([item, rows[0][1]]), decontaminate.SHINGLE)
    items = decontaminate.Items([7], [shingles[: edges[1]]], 0.8)
    own = shingles[edges[1] :]
    tracemalloc.start()
    hits, place = items.hits(own)
    assert len(items.windows(own, hits, place)) < 500
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_passages_where_one_row_is_a_third_of_all(frame, monkeypatch):
    """Equal rows are held once and come back as often as they were there."""
    from crewlens.llm import exchange

    monkeypatch.setattr(exchange, "MOST_COPIES", 5)
    body = " ".join(f"w{k}" for k in range(40))
    rows = [(5, body)] * 40 + [(6, f"x y {body} z")] * 3 + [(None, body)] * 9 + [(k, f"own {k} " + " ".join(f"u{k}{j}" for j in range(20))) for k in range(10, 60)]
    got = substrings.substring_dedup(frame(rows))
    assert by((r.doc_id, r.n_words, r.n_removed, plain.sha(r.kept_text)) for r in got.collect()) == by(plain.substrings(rows, 13))
