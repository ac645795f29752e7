"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are lower-cased A-Z; shingles have five words.  A window of m shingles can only reach similarity ``least`` = t to an item of n
if they share t (n + m) / (1 + t), so windows are looked for only where shingles of items of that size occur, counted by
prefix sums.  Such windows and all items have SimHash fingerprints of ``PRINT_WORDS`` words.  Their bits lie in 16 blocks of 16;
fingerprints within ``radius`` = 47 bits differ in at most ``FLIPS`` = 2 bits of some block, so looking up every block with up to
two bits flipped finds them all.  Of the items of a window's size about three in a hundred are met by chance.  Items that are met are
verified by the exact weighted Jaccard similarity of their shingles, also those that prove to be farther than the radius.

At a similarity of 0.8 a bit differs with a probability of about 0.15, so 39 are expected, and a window is met by no block in
about two of a million cases; its neighbours, shifted by a word, are tried as well.

Items travel to the tasks in parts of at most about ``part_bytes`` as they are held there, one written pass over the
documents for each part, so a task holds one part however large the benchmark is.  What is found is keyed by doc_id and a hash of
the text.  Defined cases: null and empty texts or items match nothing; items or texts under five words have one shingle of all
their words; equal items match alike; an empty benchmark leaves all documents clean; repeated rows are judged alike; very long
texts are judged whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .simhash import wide_bits
from .texts import id_and_text, one_array, ranges, same_row, slices, split_words, string_hashes, window_hashes, word_codes

SHINGLE = 5
LEAST = 0.8
PRINT_WORDS = 4
BLOCKS = 4 * PRINT_WORDS
FLIPS = 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
PART_BYTES = 32 << 20
ITEM_BYTES = 512  # fingerprint, index entries and objects of an item, beside 16 bytes a shingle
FILTER_BITS = 22
WINDOWS = 256
#: What is done to a block of 16 bits before it is looked up.
PROBES = np.array([sum(1 << b for b in flip) for k in range(FLIPS + 1) for flip in combinations(range(16), k)], np.int64)


def _shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles, and the texts' offsets; a shorter text has one shingle of all its words."""
    flat, offsets = split_words(texts, lower=True)
    codes, words = word_codes(flat)
    hashes = string_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    size = np.diff(offsets)
    counts = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(edges[-1]), np.uint64)
    full, first = window_hashes(hashes, offsets, n)
    doc = np.searchsorted(offsets, first, side="right") - 1
    out[edges[doc] + first - offsets[doc]] = full
    for d in np.flatnonzero((size > 0) & (size < n)).tolist():
        a, b = int(offsets[d]), int(offsets[d + 1])
        out[edges[d]] = window_hashes(hashes[a:b], np.array([0, b - a]), b - a)[0][0] ^ np.uint64(b - a)
    return out, edges


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over united shingles of two multisets."""
    keys, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(inverse[: len(a)], minlength=len(keys)), np.bincount(inverse[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


@dataclass
class Items:
    """A part of the benchmark, indexed by shingle and by blocks of the fingerprints' bits."""

    ids: list[int | None]
    shingles: list[np.ndarray]
    least: float

    def __post_init__(self):
        sizes = np.array([len(s) for s in self.shingles], np.int64)
        every = np.concatenate(self.shingles) if len(sizes) else np.zeros(0, np.uint64)
        # distinct shingles, and of each the sizes of the items that have it
        own = np.unique(np.stack([every, np.repeat(sizes, sizes).astype(np.uint64)]), axis=1) if len(every) else np.zeros((2, 0), np.uint64)
        self.known, self.first, self.count = np.unique(own[0], return_index=True, return_counts=True)
        self.own_sizes = own[1].astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - FILTER_BITS)] = True
        prints = wide_bits(every, np.concatenate([[0], np.cumsum(sizes)]), PRINT_WORDS)
        full = np.flatnonzero(sizes)
        #: Of each block the items, sorted by their size and the block's bits, and these keys.
        self.lists = []
        for value in _block_values(prints[full]).T:
            key = sizes[full] << 16 | value
            order = np.argsort(key, kind="stable")
            self.lists.append((key[order], full[order]))

    def met(self, sizes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of their sizes that agree in some block but for ``FLIPS`` bits."""
        pairs = []
        for (keys, items), value in zip(self.lists, _block_values(prints).T, strict=True):
            wanted = (sizes[:, None] << 16) + (value[:, None] ^ PROBES)
            low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
            n = (high - low).ravel()
            at = np.flatnonzero(n)
            if len(at):
                window = np.repeat(at // len(PROBES), n[at])
                pairs.append(window * len(self.ids) + items[ranges(low.ravel()[at], n[at])])
        every = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return every // max(len(self.ids), 1), every % max(len(self.ids), 1)

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of any item are, and which."""
        at = np.flatnonzero(self.filter[shingles >> np.uint64(64 - FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.known, shingles[at]), max(len(self.known) - 1, 0))
        good = self.known[place] == shingles[at] if len(at) else np.zeros(0, bool)
        return at[good], place[good]

    def windows(self, shingles: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(start, stop, size) of a document's windows that share enough shingles with items of that size; of equal windows one.

        The memory it takes follows the document's length, however often an item's shingles occur in it.
        """
        length = len(shingles)
        of_hit = self.own_sizes[ranges(self.first[place], self.count[place])]
        where = np.repeat(at, self.count[place])
        found = []
        for size in np.unique(of_hit).tolist():
            own = where[of_hit == size]
            if len(own) < self.least * size / (1 + self.least):
                continue
            # starts before the text stand for windows that it cuts short; each start once, whatever hits its window has
            begin = np.maximum(own - size + 1, np.concatenate([own[:1] - size, own[:-1]]) + 1)
            start = ranges(begin, own - begin + 1)
            a, b = np.maximum(start, 0), np.minimum(start + size, length)
            shared = np.searchsorted(own, b) - np.searchsorted(own, a)
            good = shared >= np.ceil(self.least * (size + b - a) / (1 + self.least) - 1e-9)
            spans = _distinct_windows(shingles, np.unique(np.stack([a[good], b[good]], axis=1), axis=0), size)
            found.append(np.column_stack([spans, np.full(len(spans), size)]))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def matches(self, shingles: np.ndarray, at: np.ndarray, place: np.ndarray) -> dict[int, float]:
        """Items found in one document's shingles, with the best similarity of each."""
        found: dict[int, float] = {}
        every = self.windows(shingles, at, place)
        for spans in np.array_split(every, -(-len(every) // WINDOWS)) if len(every) else ():  # bounded pieces
            length = spans[:, 1] - spans[:, 0]
            prints = wide_bits(shingles[ranges(spans[:, 0], length)], np.concatenate([[0], np.cumsum(length)]), PRINT_WORDS)
            for w, i in zip(*(x.tolist() for x in self.met(spans[:, 2], prints)), strict=True):
                if found.get(i, 0.0) < 1.0:
                    s = weighted_jaccard(shingles[spans[w, 0] : spans[w, 1]], self.shingles[i])
                    if s >= self.least and s > found.get(i, 0.0):
                        found[i] = s
        return found


def _distinct_windows(shingles: np.ndarray, spans: np.ndarray, size: int) -> np.ndarray:
    """Spans without those whose whole window has the same 64-bit hash as an earlier one."""
    whole = spans[:, 1] - spans[:, 0] == size
    if whole.sum() < 2:
        return spans
    runs = np.flatnonzero(np.diff(spans[whole, 0], prepend=-2) > 1)  # windows that begin side by side
    starts = spans[whole, 0]
    edges = np.append(runs, len(starts))
    hashes = [window_hashes(shingles[starts[i] : starts[j - 1] + size], np.array([0, starts[j - 1] + size - starts[i]]), size)[0] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    _, once = np.unique(np.concatenate(hashes), return_index=True)
    return np.concatenate([spans[~whole], spans[whole][np.sort(once)]])


def _block_values(prints: np.ndarray) -> np.ndarray:
    """The blocks of 16 bits of fingerprints, shape (rows, BLOCKS)."""
    return np.ascontiguousarray(prints).view("<u2").reshape(len(prints), BLOCKS).astype(np.int64)


def _parts(benchmark: DataFrame, least: float, part_bytes: int):
    """The benchmark in parts of bounded size, one after the other on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    held = F.lit(ITEM_BYTES) + F.octet_length("text") + 16 * F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    size = items.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // part_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        shingles, edges = _shingles(pa.array([r["text"] for r in rows], pa.string()), SHINGLE)
        if len(shingles):
            yield Items([r["item_id"] for r in rows], np.split(shingles, edges[1:-1]), least)


def _judged(items: Items, texts: pa.Array) -> list[dict[int, float]]:
    shingles, edges = _shingles(texts, SHINGLE)
    hits, place = items.hits(shingles)
    out: list[dict[int, float]] = [{} for _ in range(len(texts))]
    owner = np.searchsorted(edges, hits, side="right") - 1
    for some in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(owner)) + 1) if len(hits) else ():
        d = int(owner[some[0]])
        a, b = int(edges[d]), int(edges[d + 1])
        out[d] = items.matches(shingles[a:b], hits[some] - a, place[some])
    return out


def _found(docs: DataFrame, part) -> DataFrame:
    """(doc_id, text_hash, items, similarity) of the rows in which an item of a broadcast part is found."""

    def run(batches):
        for batch in slices(batches):
            judged = _judged(part.value, one_array(batch.column("text")))
            hit = [d for d, found in enumerate(judged) if found]
            ids = [sorted({part.value.ids[i] for i in judged[d]}, key=lambda v: (v is None, v)) for d in hit]
            best = [max(judged[d].values()) for d in hit]
            some = batch.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("text_hash"), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())],
                ["doc_id", "text_hash", "items", "similarity"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, items array<long>, similarity double")


def _hits(docs: DataFrame, benchmark: DataFrame, least: float, part_bytes: int) -> DataFrame:
    """(_id, _hash, items, similarity) of contaminated rows, over all parts of the benchmark."""
    read = id_and_text(docs, text_hash=True)
    every = None
    for items in _parts(benchmark, least, part_bytes):
        part = docs.sparkSession.sparkContext.broadcast(items)
        some = written(_found(read, part), "contaminated")
        part.destroy()  # tasks hold one part at a time
        every = some if every is None else every.union(some)
    if every is None:
        every = docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, items array<long>, similarity double")
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    key = (F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return every.groupBy(*key).agg(lists.alias("items"), F.max("similarity").alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, contaminated, items, similarity) for each row of documents: item ids found, and the best similarity."""
    read, hits = id_and_text(docs), _hits(docs, benchmark, least, part_bytes)
    return read.join(hits, same_row(read, hits, "_id", "_hash"), "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents, all columns, in which no item of the benchmark is found."""
    hits = _hits(docs, benchmark, least, part_bytes)
    return docs.join(hits, same_row(docs, hits, "_id", "_hash"), "left_anti")
