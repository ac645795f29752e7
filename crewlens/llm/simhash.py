"""SimHash near-dedup: positional-byte inverted index, count filtering, verification, components.

A fingerprint is one 64-bit word of eight positional bytes (``similar.py`` uses several).  Documents are posted under groups of three
positional bytes, not single ones, whose lists would hold a 256th of the corpus each.  In a posting list the bytes that
two fingerprints share are tallied over all positions; pairs that reach the least number of shared bytes are verified by
their differing bits.

* ``near_duplicates`` (64 bits): two fingerprints that differ in at most ``radius`` = 4 bits differ in at most four bytes,
  so they share at least four of eight, the guaranteed minimum.  20 triples are such that any four of the eight positions
  hold one of them (two groups of three positions and one of two; all triples inside a group, and those with two
  positions in a group and one in the next), so no link is missed.

Fingerprints are made distinct first, so exact copies cost one posting.  Inside a list pairs are compared in memory, and a
member that is already linked is not compared with others of its piece; only a spanning star of each connected
piece leaves the task, so a list of m fingerprints gives fewer than m rows.  A list longer than ``list_limit`` is split by a
hash into pieces, and each pair of pieces becomes a list of its own: every pair still meets, in tasks of bounded
size.  Components come from alternating large-star and small-star steps over the written edges.  Joins on fingerprints, stars'
centres and components may be hot and use ``spread_join``.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated ids stay separate rows and
share the component; a null doc_id counts as the largest id, and a component of such rows alone has a null id; very long
texts are fingerprinted whole, a million shingles at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, spread_join, task_count, written, written_at
from .texts import P1, id_and_text, mix64, one_array, ranges, same_row, shingle_hashes, slices, split_words

LIST_LIMIT = 4096
MOST_LONG = 1 << 20
BIT_ROWS = 1 << 20
SHORT_LIST = 48


@dataclass(frozen=True)
class Rule:
    """How documents are fingerprinted and when two fingerprints link."""

    shingle: int
    words: int
    radius: int
    shared: int
    triples: tuple[tuple[int, ...], ...]

    def masks(self) -> list[tuple[int, int]]:
        """Of each triple the word and the signed mask of its bytes."""
        out = []
        for t in self.triples:
            mask = sum(0xFF << (8 * (b % 8)) for b in t)
            out.append((t[0] // 8, mask - (1 << 64) if mask >> 63 else mask))
        return out


GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
NEAR = Rule(
    shingle=4,
    words=1,
    radius=4,
    shared=4,
    triples=tuple(t for g in GROUPS for t in combinations(g, 3))
    + tuple((*pair, one) for i, g in enumerate(GROUPS) for pair in combinations(g, 2) for one in GROUPS[(i + 1) % 3]),
)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64-bit number of the bits that are set in over half of them."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    start = 0
    while start < len(spans):
        stop = start + 1
        while stop < len(spans) and spans[stop][1] - spans[start][0] <= BIT_ROWS:
            stop += 1
        base, end = spans[start][0], spans[stop - 1][1]
        if stop == start + 1:
            count = np.zeros(64, np.int64)
            for a in range(base, end, BIT_ROWS):
                some = hashes[a : min(end, a + BIT_ROWS)]
                count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            counts = count[None, :]
        else:
            bits = np.unpackbits(hashes[base:end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.array([np.add.reduce(bits[a - base : b - base], axis=0, dtype=np.int64) for a, b in spans[start:stop]])
        n = np.diff(offsets[start : stop + 1])[:, None]
        out[start:stop] = np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel()
        start = stop
    return out


def wide_bits(hashes: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of ``words`` words, shape (runs, words); the first is that of the hashes, the others of scrambles of them."""
    cols = [majority_bits(hashes, offsets)]
    with np.errstate(over="ignore"):
        for k in range(1, words):
            cols.append(majority_bits(mix64(hashes + np.uint64(k) * P1), offsets))
    return np.stack(cols, axis=1)


def nodes_of(prints: np.ndarray) -> np.ndarray:
    """One number for each fingerprint: itself, or a 64-bit hash of several words."""
    out = prints[:, 0].copy()
    with np.errstate(over="ignore"):
        for k in range(1, prints.shape[1]):
            out = mix64(out * P1 + prints[:, k])
    return out


def _print_names(rule: Rule) -> list[str]:
    return [f"f{k}" for k in range(rule.words)]


def fingerprints(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """(doc_id, text_hash, node, f0, ...) for each row of documents."""
    names = ["doc_id", "text_hash", "node", *_print_names(rule)]

    def run(batches):
        for batch in slices(batches):
            hashes, offsets = shingle_hashes(*split_words(one_array(batch.column("text")), lower=True), rule.shingle)
            prints = wide_bits(hashes, offsets, rule.words)
            found = [pa.array(x.view(np.int64)) for x in (nodes_of(prints), *np.ascontiguousarray(prints.T))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *found], names)

    return id_and_text(docs, text_hash=True).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Places at which two arrays of fingerprints (rows, words) share enough bytes and differ in few bits."""
    apart = a ^ b
    shared = (apart.view(np.uint8).reshape(len(apart), 8 * apart.shape[1]) == 0).sum(1)  # the tally
    at = np.flatnonzero(shared >= rule.shared)
    return at[np.bitwise_count(apart[at]).sum(1, dtype=np.int64) <= rule.radius]


def _stars_of_short(fp: np.ndarray, length: np.ndarray, first: np.ndarray, rule: Rule) -> np.ndarray:
    """Of short lists laid end to end: each member's smallest connected place."""
    label = np.arange(len(fp))
    left = np.repeat(first + length, length) - label - 1
    links = []
    for lag in range(1, int(length.max(initial=1))):
        i = np.flatnonzero(left >= lag)
        i = i[_linked(fp[i], fp[i + lag], rule)]
        if len(i):
            links.append(np.stack([i, i + lag]))
    if links:
        a, b = np.concatenate(links, axis=1)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    return label


def _stars_of_long(fp: np.ndarray, rule: Rule) -> np.ndarray:
    """The same for one long list: what is linked leaves those that are still compared."""
    label = np.arange(len(fp))
    rest = np.arange(1, len(fp))
    front, root = [0], 0
    while front or len(rest):
        if not front:
            root, rest = int(rest[0]), rest[1:]
            front = [root]
        at = front.pop()
        if not len(rest):
            break
        hit = _linked(fp[rest], fp[at][None, :], rule)
        if len(hit):
            found = rest[hit]
            label[found] = root
            front.extend(found.tolist())
            rest = np.delete(rest, hit)
    return label


def _stars(key: np.ndarray, fp: np.ndarray, rule: Rule) -> pa.RecordBatch:
    """(u, v): of whole lists, sorted by key, members and the first member of their connected piece, where it is another."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.concatenate([first, [len(key)]]))
    short = (length > 1) & (length <= SHORT_LIST)
    rows, size = ranges(first[short], length[short]), length[short]
    found = rows[_stars_of_short(fp[rows], size, np.cumsum(size) - size, rule)]
    member, root = [rows], [found]
    for a, n in zip(first[length > SHORT_LIST].tolist(), length[length > SHORT_LIST].tolist(), strict=True):
        member.append(np.arange(a, a + n))
        root.append(a + _stars_of_long(fp[a : a + n], rule))
    member, root = np.concatenate(member), np.concatenate(root)
    other = member != root
    u, v = (nodes_of(fp[x[other]]).view(np.int64) for x in (member, root))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _met(rule: Rule):
    """Streams over (key, f0, ...), sorted, and yields the stars of each list; the last list of a batch is held back."""
    names = _print_names(rule)

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros((0, rule.words), np.uint64)
        for batch in batches:
            new = np.stack([np.asarray(batch.column(x)).view(np.uint64) for x in names], axis=1)
            key = np.concatenate([key, np.asarray(batch.column("key"))])
            fp = np.concatenate([fp, new])
            if len(key) and key[0] != key[-1]:
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                yield _stars(key[:cut], fp[:cut], rule)
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield _stars(key, fp, rule)

    return run


def dealt_lists(index: DataFrame, names: list[str], list_limit: int, stay: bool = False) -> DataFrame:
    """Postings (key, names) with whole lists in a task, sorted by key; lists beyond ``list_limit`` are split into pieces that meet in pairs.

    With ``stay`` the table of long lists is written first and broadcast where it has at most ``MOST_LONG`` rows, so that rows of a hot list stay
    spread until they are split; else its join is left to the planner.
    """
    long = index.groupBy("key").count().filter(F.col("count") > list_limit)  # few; their rows are spread by the pieces
    if stay:
        long = written(long, "long-lists")
        long = F.broadcast(long) if long.count() <= MOST_LONG else long
    pieces = F.coalesce(F.ceil(2 * F.col("count") / list_limit), F.lit(1)).cast("int")
    placed = index.join(long, "key", "left").withColumn("pieces", pieces)
    own = F.pmod(F.xxhash64(*names), F.col("pieces"))
    lists = F.when(F.col("pieces") == 1, F.array("key")).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1),
            lambda o: F.xxhash64(F.col("key"), F.least(own, o), F.greatest(own, o)),
        )
    )
    return placed.select(*names, F.explode(lists).alias("key")).repartition("key").sortWithinPartitions("key", *names)


def edges(distinct: DataFrame, rule: Rule = NEAR, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(u, v): links between nodes of distinct fingerprints (f0, ...) whose components are those of all links."""
    names = _print_names(rule)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col(f"f{w}").bitwiseAND(F.lit(m))) for i, (w, m) in enumerate(rule.masks())])
    index = distinct.select(*names, F.explode(keys).alias("key"))
    dealt = dealt_lists(index, names, list_limit)
    return dealt.mapInArrow(_met(rule), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(u, root): the smallest node of each node's component, for nodes that are not it."""
    spark = links.sparkSession
    both = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    graph, path = written_at(both, "links")
    while True:
        before = _print(graph)
        around = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = spread_join(around, least, ["u"], "degree", 2 * before[0])  # a centre may have a third of all edges
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        step = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        old, (graph, path) = path, written_at(step, "links")
        discard(spark, old)
        if _print(graph) == before:
            return graph.select("u", F.col("v").alias("root"))


def _print(graph: DataFrame) -> tuple:
    """Whether a step has changed the edges: their number and a sum of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(graph.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first())


def _grouped(docs: DataFrame, rule: Rule, list_limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of fingerprints(), and of each fingerprint (node, root, copies), root being the node of its component."""
    fps = written(fingerprints(docs, rule), "fingerprints")
    names = _print_names(rule)
    distinct = written(
        fps.groupBy("node", *names).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct"
    )
    roots = components(edges(distinct.select(*names), rule, list_limit)).select(F.col("u").alias("node"), "root")
    rooted = distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "copies")
    return fps, written(rooted, "rooted")


def near_duplicates(docs: DataFrame, rule: Rule = NEAR, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents."""
    fps, rooted = _grouped(docs, rule, list_limit)
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_node = spread_join(rooted, groups, ["root"], "members", rooted.count()).select("node", "component_id", "copies")
    named = spread_join(fps, of_node, ["node"], "copies", fps.count())
    word = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return named.select("doc_id", F.concat(*[word(x) for x in _print_names(rule)]).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, rule: Rule, list_limit: int = LIST_LIMIT) -> DataFrame:
    """The documents, all columns: one row of each near-duplicate group.

    It is the row with the smallest id, then hash of the text, then the other columns, also where ids are null or repeated.
    """
    fps, rooted = _grouped(docs, rule, list_limit)
    of_node = first_rows(fps)
    first = rooted.join(of_node, "node").groupBy("root").agg(F.min("k").alias("k"))
    return chosen_rows(docs, fps, first.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")))


def first_rows(fps: DataFrame) -> DataFrame:
    """(node, k): of each fingerprint the row with the smallest id, then hash of the text; null ids come last."""
    return fps.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))


def chosen_rows(docs: DataFrame, fps: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of documents whose id and hash of the text are among ``chosen`` (_id, _hash), each of them once."""
    counted = fps.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    kept = written(
        counted.join(chosen, counted["_id"].eqNullSafe(chosen["_id"]) & (counted["_hash"] == chosen["_hash"]), "left_semi"), "kept"
    )
    once, often = kept.filter("_n = 1"), kept.filter("_n > 1")
    single = docs.join(once, same_row(docs, once, "_id", "_hash"), "left_semi")
    many = docs.join(often, same_row(docs, often, "_id", "_hash"), "left_semi").select(F.struct(*[docs[x] for x in docs.columns]).alias("w"))
    return single.union(many.groupBy("w.doc_id", F.xxhash64(F.coalesce("w.text", F.lit("")))).agg(F.min("w").alias("w")).select("w.*"))
