"""Near-duplicates of similarity 0.8: SimHash finds candidates, whole sets of shingles decide.

For a similarity of 0.8 a fingerprint's bit differs with a probability of arccos(8/9) / pi, 0.15, so no byte of 64 bits is sure to be shared.
A document gets ``WORDS`` fingerprint words of eight positional bytes, of scrambles of the same shingle hashes; it is posted, word by word, under
the triples of five groups of four bytes.  Documents that meet in a list are compared by the word of that list (bytes shared, then at most
``WORD_RADIUS`` differing bits), then by all words (``RADIUS``), which leaves next to no pair of unlike texts.

Links are then compared in full: those of texts whose sets of five-word shingles have a Jaccard similarity below ``LEAST`` are left out.  What is
linked forms components.  In each the text with the smallest id stays, and every other one is compared with it; those that are alike go.
Those that are not form components of the links among them, in which the first ``HEADS`` texts are compared with all later ones, and so
on until no link is left.  So a text goes only if a text that stays is as similar to it as asked; most groups end with one
comparison a document, and no group is ever compared pair by pair.

Fingerprints can miss links, so they only thin out the groups; the texts that are left are then joined exactly.  Sets A and B of a similarity
of 0.8 differ in at most (|A| + |B|) / 9 shingles, and their sizes lie in the same class of ratio 1.25 or in neighbouring ones.  For each of its two pairs of classes a
text's shingles are dealt by hash into a fourth as many buckets as the largest set has shingles, which is more than can differ, so at least one bucket is the
same in both.  A text is posted under the contents of its buckets: of those that hold anything, where these alone are more than can differ, else of
all.  Every shingle that differs spoils one bucket at most, so of two alike texts all postings but so many are shared (``_enough``); pairs that share as
many and are of fitting sizes are compared in full.  A text that goes only now leaves those that went because of it to a last join with all that stay.

Defined cases: texts with the same words of fingerprint count as one text, of which one row stays (null and empty texts among them); a
text with fewer than five words has one shingle of all its words; null ids come last; repeated rows are copies; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import brief_shuffles, scratch, spread_join, written
from .simhash import LIST_LIMIT, Rule, chosen_rows, components, dealt_lists, fingerprints, first_rows
from .texts import P1, P2, id_and_text, mix64, one_array, same_row, shingle_hashes, slices, split_words

WORDS, SHINGLE, LEAST = 8, 5, 0.8
WORD_RADIUS, RADIUS = 12, 100
#: Ratio of sizes of a class, shingles of the largest set in a bucket, and from which length on a list is split by a second exchange.
RATIO, IN_BUCKET, LONG = 1.25, 4, 256
SHORT = 8
#: How many texts of a component others are compared with, round by round; the last number holds on.
HEADS = (1, 16, 64)
FOURS = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 1, 6, 7))
RULE = Rule(shingle=SHINGLE, words=WORDS, radius=RADIUS, shared=3, triples=tuple(t for w in range(WORDS) for four in FOURS for t in combinations([8 * w + b for b in four], 3)))


def _tree(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of a list, each linked by the list's word, that connect all that is connected."""
    if len(word) <= SHORT:
        a, b = np.triu_indices(len(word), 1)
        near = np.bitwise_count(word[a] ^ word[b]) <= WORD_RADIUS
        return a[near], b[near]
    rest = np.arange(1, len(word))
    front, left, right = [0], [], []
    while front or len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        at = front.pop()
        if not len(rest):
            break
        near = np.bitwise_count(word[rest] ^ word[at]) <= WORD_RADIUS
        found = rest[near]
        left += [np.full(len(found), at)]
        right += [found]
        front.extend(found.tolist())
        rest = rest[~near]
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def _lists(key: np.ndarray, node: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    size = np.diff(edges)
    two = edges[:-1][size == 2]  # by far the most of those that link anything
    near = two[np.bitwise_count(word[two] ^ word[two + 1]) <= WORD_RADIUS]
    u, v = [node[near]], [node[near + 1]]
    for a, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        i, j = _tree(word[a : a + n])
        u.append(node[a + i])
        v.append(node[a + j])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], ["u", "v"])


def _met(batches):
    """Streams over (key, node, word), sorted by key; the last list of a batch is held back."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        new = (np.asarray(batch.column("key")), np.asarray(batch.column("node")), np.asarray(batch.column("word")).view(np.uint64))
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
            yield _lists(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield _lists(*held)


def met_links(prints: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(u, v), a table: nodes of prints (node, f0, ...) that met in a list and differ in at most ``RADIUS`` bits of all words."""
    posts = [F.struct(F.xxhash64(F.lit(i), F.col(f"f{w}").bitwiseAND(F.lit(m))).alias("key"), F.col(f"f{w}").alias("word")) for i, (w, m) in enumerate(RULE.masks())]
    index = prints.select("node", F.explode(F.array(*posts)).alias("p")).select("node", "p.key", "p.word")
    met = dealt_lists(index, ["node", "word"], list_limit, stay=True).mapInArrow(_met, "u long, v long")
    with scratch(prints.sparkSession) as put:
        return _near(put(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "met"), prints, put)


def _near(pairs: DataFrame, prints: DataFrame, put) -> DataFrame:
    """The pairs that differ in at most ``RADIUS`` bits of all words, as a table."""
    names, n = [f"f{k}" for k in range(WORDS)], pairs.count()
    left = prints.join(pairs.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node").select(F.col("node").alias("u"), F.array(*names).alias("a"), "n")
    right = prints.join(pairs.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node").select(F.col("node").alias("v"), F.array(*names).alias("b"), "n")
    both = spread_join(put(spread_join(pairs, put(left, "left"), ["u"], "n", n), "half"), put(right, "right"), ["v"], "n", n)
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return written(both.filter(apart <= RADIUS).select("u", "v"), "near")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): sorted distinct 64-bit hashes of the shingles of the rows ``wanted`` (node, _id, _hash)."""

    def run(batches):
        for batch in slices(batches):
            hashes, offsets = shingle_hashes(*split_words(one_array(batch.column("text")), lower=True), SHINGLE)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    read = id_and_text(docs)
    rows = read.join(wanted, same_row(read, wanted, "_id", "_hash")).select("node", "text")
    return rows.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _compared(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """The pairs with ``shingles`` and ``other`` that are similar enough, without these two."""

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("shingles"), batch.column("other"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= LEAST * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(keep).filter(pa.array(good, pa.bool_()))

    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep))


def alike(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs, a written table with nodes ``a`` and ``b``, whose sets of shingles are similar enough, as a table; either node may be hot."""
    total = pairs.count()

    def with_sets(rows: DataFrame, node: str, name: str, put) -> DataFrame:
        asked = pairs.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        table = sets.join(asked, "node").select(F.col("node").alias(node), F.col("shingles").alias(name), "n")
        return spread_join(rows, put(table, "sets"), [node], "n", total)

    with scratch(pairs.sparkSession) as put:
        half = put(with_sets(pairs, a, "shingles", put), "half")
        return written(_compared(with_sets(half, b, "other", put), pairs.columns), "alike")


def _posted(hashes: np.ndarray, size: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places of sets) of the postings of sets laid end to end, in the pair of classes that is ``up`` above their own."""
    with np.errstate(over="ignore"):
        group = _classes(size) + up
        most = RATIO ** (group + 1.0)
        buckets = np.floor(most / IN_BUCKET).astype(np.int64) + 1
        first = np.cumsum(buckets) - buckets
        place = np.repeat(first, size) + (hashes % np.repeat(buckets, size).astype(np.uint64)).astype(np.int64)
        held = np.bincount(place, minlength=int(buckets.sum())) > 0
        told = np.zeros(len(held), np.uint64)
        np.add.at(told, place, mix64(hashes))
        of = np.repeat(np.arange(len(size)), buckets)
        apart = np.floor(np.minimum(size * (1 + RATIO), size + most) * (1 - LEAST) / (1 + LEAST) + 1e-9)
        enough = np.bincount(of, held, len(size)) > apart
        at = np.flatnonzero(held | ~enough[of])
        number = (group[of[at]] << 40 | (at - first[of[at]])).astype(np.uint64)
        return mix64(told[at] * P1 + mix64(number * P2 + held[at].astype(np.uint64))), of[at]


def _signed(hashes: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes) of the postings of sets laid end to end; sets of a similarity of ``LEAST`` have at least one key in common."""
    keys, of = zip(*[_posted(hashes, size, up) for up in (0, 1)], strict=True)
    return np.concatenate(keys).view(np.int64), node[np.concatenate(of)]


def _classes(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(size) / np.log(RATIO) + 1e-9).astype(np.int64)


def signatures(docs: DataFrame, wanted: DataFrame, counted: bool = False) -> DataFrame:
    """(key, node): postings of the rows ``wanted`` (node, _id, _hash); texts without words have none.

    If ``counted``, instead of each text (node, size, class, own, next): its shingles, and its postings in its own pair of classes and in the next.
    """

    def run(batches):
        for batch in slices(batches):
            hashes, offsets = shingle_hashes(*split_words(one_array(batch.column("text")), lower=True), SHINGLE)
            sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            size = np.array([len(x) for x in sets], np.int64)
            some = size > 0
            if some.any():
                node, size = np.asarray(batch.column("node"))[some], size[some]
                if counted:
                    own = [np.bincount(_posted(np.concatenate(sets), size, up)[1], minlength=len(size)) for up in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, size, _classes(size), *own)], ["node", "size", "class", "own", "next"])
                    continue
                cols = _signed(np.concatenate(sets), node, size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "node"])

    read = id_and_text(docs)
    return read.join(wanted, same_row(read, wanted, "_id", "_hash")).select("node", "text").mapInArrow(run, "node long, size long, class long, own long, next long" if counted else "key long, node long")


def _paired(most: int | None):
    """Streams over (key, node), sorted by key, and yields all pairs of each list; of one beyond ``most`` its postings, for a second exchange."""

    def of(key: np.ndarray, node: np.ndarray):
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        yield node[two], node[two + 1], False
        for a, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if most and n > most:
                yield key[a : a + n], node[a : a + n], True
                continue
            for i in range(n - 1):  # a row of pairs at a time
                yield np.full(n - 1 - i, node[a + i]), node[a + i + 1 : a + n], False

    def out(key: np.ndarray, node: np.ndarray):
        held: list[tuple[np.ndarray, np.ndarray, bool]] = []
        count = 0
        for part in of(key, node):
            held.append(part)
            count += len(part[0])
            if count > 1 << 18:
                yield batch(held)
                held, count = [], 0
        if count:
            yield batch(held)

    def batch(parts) -> pa.RecordBatch:
        u, v, long = (np.concatenate(x) for x in zip(*[(a, b, np.full(len(a), c)) for a, b, c in parts], strict=True))
        low, high = np.where(long, u, np.minimum(u, v)), np.where(long, v, np.maximum(u, v))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (low, high, long)], ["u", "v", "long"])

    def run(batches):
        key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            key, node = np.concatenate([key, np.asarray(b.column("key"))]), np.concatenate([node, np.asarray(b.column("node"))])
            if len(key) and key[0] != key[-1]:
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                yield from out(key[:cut], node[:cut])
                key, node = key[cut:], node[cut:]
        if len(key):
            yield from out(key, node)

    return run


def _enough(a: Column, b: Column, shared: Column) -> Column:
    """Whether two texts, rows of ``signatures`` counted, share as many postings as alike ones must; a posting may be counted twice."""
    apart = F.floor((a["size"] + b["size"]) * F.lit((1 - LEAST) / (1 + LEAST)) + F.lit(1e-9))
    least = lambda x, y: F.greatest(F.least(a[x], b[y]) - apart, F.lit(0))
    needed = (
        F.when(a["class"] == b["class"], least("own", "own") + least("next", "next"))
        .when(a["class"] + 1 == b["class"], least("next", "own"))
        .when(b["class"] + 1 == a["class"], least("own", "next"))
    )  # null of others, which cannot be alike
    return (F.least(a["size"], b["size"]) >= F.lit(LEAST) * F.greatest(a["size"], b["size"]) - F.lit(1e-9)) & (shared >= needed)


def _fitting(docs: DataFrame, rows: DataFrame, pairs: DataFrame, put) -> DataFrame:
    """Of the pairs (u, v, shared) of rows (node, _id, _hash), those that share enough postings; either node may be hot."""
    asked = [pairs.groupBy(F.col(x).alias("node")).agg(F.count(F.lit(1)).alias("n")) for x in ("u", "v")]
    ends = asked[0].select("node").union(asked[1].select("node")).distinct()
    sizes, total = put(signatures(docs, put(rows.join(ends, "node"), "ends"), counted=True), "sizes"), pairs.count()
    told = F.struct("size", "class", "own", "next")
    for node, name, n in (("u", "a", asked[0]), ("v", "b", asked[1])):
        table = sizes.dropDuplicates(["node"]).join(n, "node").select(F.col("node").alias(node), told.alias(name), "n")
        pairs = put(spread_join(pairs, put(table, "told"), [node], "n", total), "fitting")
    return pairs.filter(_enough(F.col("a"), F.col("b"), F.col("shared"))).select("u", "v")


def exact_links(docs: DataFrame, nodes: DataFrame, list_limit: int = LIST_LIMIT, put=written) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links (u, v) between the texts ``nodes`` (node, k, order), with what ``_settled`` asks of their ends: (node, k), k being their order, and their sets.

    All three are tables that ``put`` has written.
    """
    rows = nodes.select("node", F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.col("order").alias("k"))
    index = signatures(docs, rows.drop("k")).repartition("key").sortWithinPartitions("key", "node")
    met = put(index.mapInArrow(_paired(LONG), "u long, v long, long boolean"), "met-exact")
    dealt = dealt_lists(met.filter("long").select(F.col("u").alias("key"), F.col("v").alias("node")), ["node"], list_limit, stay=True)
    pairs = met.filter("not long").union(dealt.mapInArrow(_paired(None), "u long, v long, long boolean"))
    pairs = put(pairs.filter("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared")), "met")
    pairs = put(_fitting(docs, rows.drop("k"), pairs, put), "pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = put(rows.join(ends, "node"), "wanted")
    sets = put(shingle_sets(docs, wanted.drop("k")), "shingles")
    return alike(pairs, sets, "u", "v"), wanted.select("node", "k"), sets


def _settled(linked: DataFrame, wanted: DataFrame, sets: DataFrame, heads: int) -> tuple[DataFrame, DataFrame]:
    """(node) of texts that stay, and (node, head) of texts that go because of one of them, the head, in components of the links."""
    roots = components(linked).select(F.col("u").alias("node"), "root")
    nodes = linked.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    first = W.partitionBy("root").orderBy("k", "node")
    ranked = written(placed.join(wanted.select("node", "k"), "node"), "placed")
    head = ranked.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= heads)
    lists = head.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("i", "k", "node"))).alias("heads"))  # so many at most
    members = ranked.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    table = written(lists.join(members, "root"), "heads")
    each = spread_join(ranked, table, ["root"], "members", ranked.count())
    earlier = F.filter("heads", lambda h: (h["k"] < F.col("k")) | ((h["k"] == F.col("k")) & (h["node"] < F.col("node"))))
    own = F.get(F.filter("heads", lambda h: h["node"] == F.col("node")), F.lit(0))["i"]
    asked = each.select("root", "node", own.alias("own"), F.explode(earlier).alias("h")).select("root", "node", "own", F.col("h.i").alias("i"), F.col("h.node").alias("head"))
    found = alike(written(asked, "asked"), sets, "node", "head")
    # of the heads those that are like an earlier one that stays go
    none = F.array().cast("array<int>")
    step = lambda out, p: F.when(~F.array_contains(out, p["i"]) & ~F.array_contains(out, p["own"]), F.concat(out, F.array(p["own"]))).otherwise(out)
    among = found.filter("own is not null").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("own", "i"))).alias("p"))
    out = written(among.select("root", F.aggregate("p", none, step).alias("out")), "out")
    hot = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(out, "root", "left").select("root", F.coalesce("out", none).alias("out"), "n")
    judged = spread_join(found, written(hot, "judged"), ["root"], "n", found.count())
    gone = written(judged.filter(~F.array_contains("out", F.col("i"))).groupBy("node").agg(F.min("head").alias("head")), "gone")
    holding = F.filter("heads", lambda h: ~F.array_contains(F.coalesce(F.col("out"), none), h["i"]))
    stays = table.join(out, "root", "left").select(F.explode(F.transform(holding, lambda h: h["node"])).alias("node"))
    return stays, gone


def _all_settled(linked: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, head): texts that go, and a text that stays because of which they go."""
    gone, k = linked.select(F.col("u").alias("node"), F.col("v").alias("head")).limit(0), 0
    while linked.count():
        stays, went = _settled(linked, wanted, sets, HEADS[min(k, len(HEADS) - 1)])
        gone, k = gone.union(went), k + 1
        done = written(stays.union(went.select("node")), "settled")
        rest = linked.join(done.withColumnRenamed("node", "u"), "u", "left_anti").join(done.withColumnRenamed("node", "v"), "v", "left_anti")
        linked = written(rest.select("u", "v"), "links")
    return gone


def gone_by_prints(docs: DataFrame, prints: DataFrame, first: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(node, head): what fingerprints find of the texts that are as similar as asked to one that stays; ``first`` has (node, k) of ``first_rows``."""
    met = met_links(prints, list_limit)
    ends = met.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    with scratch(docs.sparkSession) as put:
        wanted = put(first.join(ends, "node").select("node", F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), "k"), "wanted")
        sets = put(shingle_sets(docs, wanted.drop("k")), "shingles")
        return written(_all_settled(alike(met, sets, "u", "v"), wanted, sets), "gone")


def gone_by_all(docs: DataFrame, nodes: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(node, head): what the exact join finds of the texts ``nodes`` (node, k, order) that are as similar as asked to one that stays."""
    with scratch(docs.sparkSession) as put:
        return written(_all_settled(*exact_links(docs, nodes, list_limit, put)), "gone")


def gone_nodes(docs: DataFrame, prints: DataFrame, first: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(node): all texts that are as similar as asked to a text that stays; no two that stay are."""
    gone = gone_by_prints(docs, prints, first, list_limit)
    heads = gone.select(F.col("head").alias("node")).distinct().withColumn("has", F.lit(True))
    kept = first.join(gone, "node", "left_anti").join(heads, "node", "left")
    kept = written(kept.select("node", "k", F.struct(F.col("has").isNull().alias("alone"), "k").alias("order")), "kept")  # a text that others went for stays first
    later = gone_by_all(docs, kept, list_limit)
    left = gone.join(later.select(F.col("node").alias("head")), "head", "left_semi").select("node")
    orphans = written(first.join(left, "node"), "orphans")
    if orphans.isEmpty():
        return gone.union(later).select("node")
    stay = kept.join(later, "node", "left_anti")
    pool = stay.select("node", "k", F.lit(False).alias("again")).union(orphans.select("node", "k", F.lit(True)))
    last = gone_by_all(docs, pool.select("node", "k", F.struct("again", "k").alias("order")), list_limit)
    return gone.join(orphans, "node", "left_anti").select("node").union(later.select("node")).union(last.select("node"))


def one_of_each_similar(docs: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """The documents, all columns, without those that are near-duplicates of one that stays; one row of each text stays."""
    with brief_shuffles(docs.sparkSession):
        fps = written(fingerprints(docs, RULE), "fingerprints")
        first = written(first_rows(fps), "first-rows")
        prints = written(fps.select("node", *[f"f{k}" for k in range(WORDS)]).distinct(), "distinct")
        gone = written(gone_nodes(docs, prints, first, list_limit), "gone")
        kept = first.join(gone, "node", "left_anti")
        return chosen_rows(docs, fps, kept.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")))
