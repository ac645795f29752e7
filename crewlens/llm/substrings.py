"""Substring dedup: a count-min sketch of word windows picks those that may repeat, then they are grouped exactly.

First pass: every block counts its windows in ``rows`` hashed rows of cells and sends the occupied cells, as
gaps between sorted numbers, to the ranges that merge them; a range answers one bit a cell, set where the
merged count is two or more.  Counts are only ever overestimated, so a window that repeats has its bit in
every row.  Second pass: windows with all bits set are grouped exactly, by 128 bits, with the smallest
doc_id of each; a range answers one bit a window.  The number of cells follows the corpus, so the sketch is as selective at any size, and it
is held in parts by the ranges, never whole in one place.

Defined cases: null or empty texts have no words; texts shorter than a window stay whole; a window that
repeats only inside one document stays; equal ids in repeated rows count as one document; a null doc_id counts
as the largest id; an empty table gives an empty result; a very long text is a block of its own, taken whole.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Blocks, Keys, Replies, bits_or_none, by_key, by_range, seen_before
from .shared import free_shuffles, written
from .texts import P1, mix64, one_array, split_words, string_hashes, window_hashes, word_codes

WINDOW = 13
SKETCH_ROWS = 2
GAPS = (np.uint8, np.uint16, np.uint32, np.uint64)


class _Windows:
    def __init__(self, docs: pa.Table, n: int):
        self.flat, self.offsets = split_words(one_array(docs.column("text")))
        self.codes, self.words = word_codes(self.flat)
        self.n = n
        self.h1, self.first = window_hashes(string_hashes(self.words)[self.codes], self.offsets, n)
        counts = np.maximum(np.diff(self.offsets) - (n - 1), 0)
        self.ids = Keys.rank(docs.column("doc_id")).repeat(counts)

    def h2(self, at: np.ndarray) -> np.ndarray:
        """A second hash of some windows."""
        words, first = mix64(string_hashes(self.words, 7))[self.codes], self.first[at]
        out = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                out = out * P1 + words[first + k]
        return mix64(out)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The window's cell in a row of the sketch, as the high bits of a number."""
    with np.errstate(over="ignore"):
        scrambled = mix64(h + np.uint64(row) * P1)
    return scrambled >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _pack(cells: np.ndarray, many: np.ndarray, bits: int) -> bytes:
    """Sorted cells as gaps of the smallest fitting width, and a bit for those counted twice or more."""
    gaps = np.diff(cells >> np.uint64(64 - bits))
    width = next(i for i, x in enumerate(GAPS) if not len(gaps) or int(gaps.max()) <= np.iinfo(x).max)
    head = struct.pack("<IBQ", len(cells), width, int(cells[0]))
    return head + gaps.astype(GAPS[width]).tobytes() + np.packbits(many).tobytes()


def _unpack(payload: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    count, width, first = struct.unpack_from("<IBQ", payload)
    gaps = np.frombuffer(payload, GAPS[width], count - 1, 13)
    cells = np.cumsum(np.concatenate([[np.uint64(first >> (64 - bits))], gaps.astype(np.uint64)]), dtype=np.uint64)
    return cells, np.unpackbits(np.frombuffer(payload, np.uint8, offset=13 + gaps.nbytes), count=count).astype(bool)


def _merge(parts: list[bytes], bits: int) -> list[bytes | None]:
    got = [_unpack(p, bits) for p in parts]
    cells = np.concatenate([c for c, _ in got])
    order = np.argsort(cells, kind="stable")
    ordered = cells[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.concatenate([m for _, m in got])[order]
    new = np.concatenate([[True], ~same])
    hit = np.logical_or.reduceat(twice | np.concatenate([same, [False]]), np.flatnonzero(new))
    flags = np.empty(len(cells), bool)
    flags[order] = hit[np.cumsum(new) - 1]
    edges = np.cumsum([len(c) for c, _ in got])[:-1]
    return [np.packbits(f).tobytes() if f.any() else None for f in np.split(flags, edges)]


def substring_dedup(docs: DataFrame, window: int = WINDOW, rows: int = SKETCH_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words under windows that an earlier document has are taken out."""
    blocks = Blocks(docs)
    spans = blocks.ranges
    bits = min(64, max(16, int(np.ceil(np.log2(max(blocks.bytes, 2) / 2)))))

    def sketch(docs: pa.Table):
        w, out = _Windows(docs, window), []
        if len(w.h1):
            for row in range(rows):
                cells, counts = np.unique(_cells(w.h1, row, bits), return_counts=True)
                owner, edges = by_range(cells, spans)
                for r, a, b in zip(owner.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    out.append((row * spans + r, _pack(cells[a:b], counts[a:b] > 1, bits)))
        return out

    def perhaps(w: _Windows, got: Replies) -> np.ndarray:
        """Windows whose cells are set in every row of the merged sketch."""
        maybe = np.ones(len(w.h1), bool)
        for row in range(rows if len(w.h1) else 0):
            cells, inverse = np.unique(_cells(w.h1, row, bits), return_inverse=True)
            flags = np.zeros(len(cells), bool)
            owner, edges = by_range(cells, spans)
            for r, a, b in zip(owner.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if bits_ := got.get(row * spans + r):
                    flags[a:b] = np.unpackbits(np.frombuffer(bits_, np.uint8), count=b - a)
            maybe &= flags[inverse]
        return np.flatnonzero(maybe)

    def candidates(docs: pa.Table, replies: pa.Table):
        w = _Windows(docs, window)
        at = perhaps(w, by_key(replies))
        return [(rows * spans + r, x) for r, x in Keys(w.h1[at], w.h2(at), w.ids[at]).parts(spans)]

    def finish(docs: pa.Table, replies: Replies) -> pa.Table:
        w = _Windows(docs, window)
        at = perhaps(w, replies)  # the same windows, in the same order, as were sent
        keys = Keys(w.h1[at], w.h2(at), w.ids[at])
        exact = {r - rows * spans: x for r, x in replies.items() if r >= rows * spans}
        late = keys.flags(exact, spans)[keys.group] | keys.late
        starts = w.first[at[late]]
        edge = np.zeros(len(w.flat) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        ends = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
        n = np.diff(w.offsets)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), w.flat.filter(pa.array(keep)))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "copies": docs.column("copies"),
                "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(n - np.diff(ends), pa.int64()),
                "kept_text": pc.binary_join(lists, " "),
            }
        )

    seen = written(blocks.exchange(sketch, lambda parts: _merge(parts, bits)), "sketch")
    free_shuffles(docs.sparkSession)  # that of the texts is made anew
    exact = blocks.exchange(candidates, lambda parts: [bits_or_none(x) for x in seen_before(parts)], seen)
    done = blocks.finished(seen.union(exact), finish, "doc_id long, copies long, n_words long, n_removed long, kept_text string")
    return done.select("doc_id", "n_words", "n_removed", "kept_text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
