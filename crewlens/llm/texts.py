"""Vectorised text helpers that run inside tasks, and the frame conventions shared by the operators.

Conventions: a null text counts as empty; a null ``doc_id`` stays null and counts as the largest id; rows that
repeat an id stay separate rows; only ``doc_id`` and ``text`` are read, so names of other columns cannot clash; long texts
are taken whole, one at a time if need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20

# The five primes of the public XXH64 specification.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)


def id_and_text(docs: DataFrame, text_hash: bool = False) -> DataFrame:
    """Only the two columns that the operators read, the text without nulls, and its hash where it is asked for."""
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return read.withColumn("text_hash", F.xxhash64("text")) if text_hash else read


def same_row(left: DataFrame, right: DataFrame, doc_id: str, text_hash: str):
    """Whether rows of documents have the id and the hash of the text of rows of another frame; null ids are alike."""
    mine = F.xxhash64(F.coalesce(left["text"], F.lit("")))
    return left["doc_id"].cast("long").eqNullSafe(right[doc_id]) & (mine == right[text_hash])


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each piece has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def one_array(column) -> pa.Array:
    """A chunked or plain string column as one array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.string()), "")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of characters other than ASCII white space: all words, and each text's offsets."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.not_equal(flat, ""), dtype=bool)
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return flat, offsets


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string array."""
    _, ends, data = strings.buffers()
    edges = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), edges[:-1], np.diff(edges)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of one byte buffer at once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lane8 = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        lane4 = np.ndarray((len(padded) - 3,), "<u4", padded.data, strides=(1,))
        s = np.uint64(seed)
        order = np.argsort(-length, kind="stable")
        pos, left = start[order].astype(np.int64), length[order].astype(np.int64)
        total = left.astype(np.uint64)
        h = np.full(len(pos), s + P5, np.uint64)
        wide = int(np.searchsorted(-left, -32, side="right"))
        if wide:
            acc = [np.full(wide, v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            stripe = 0
            while count := int(np.searchsorted(-left, -32 * (stripe + 1), side="right")):
                for j in range(4):
                    acc[j][:count] = _rot(acc[j][:count] + lane8[pos[:count] + (32 * stripe + 8 * j)] * P2, 31) * P1
                stripe += 1
            mixed = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                mixed = (mixed ^ (_rot(a * P2, 31) * P1)) * P1 + P4
            h[:wide] = mixed
            pos[:wide] += left[:wide] // 32 * 32
        h += total
        left %= 32
        for k in range(3):
            i = np.flatnonzero(left >= 8 * (k + 1))
            h[i] = _rot(h[i] ^ (_rot(lane8[pos[i] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
        pos += left // 8 * 8
        left %= 8
        i = np.flatnonzero(left >= 4)
        h[i] = _rot(h[i] ^ (lane4[pos[i]].astype(np.uint64) * P1), 23) * P2 + P3
        pos[i] += 4
        left[i] -= 4
        for k in range(3):
            i = np.flatnonzero(left > k)
            h[i] = _rot(h[i] ^ (padded[pos[i] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        out = np.empty_like(h)
        out[order] = h
        return out


def string_hashes(strings: pa.Array, seed: int = 42) -> np.ndarray:
    return xxh64(*raw(strings), seed=seed)


def word_codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as an index into the distinct words."""
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of words that repeat the word before them in their text."""
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    begin = offsets[:-1]
    same[begin[begin < len(codes)]] = False
    return np.flatnonzero(same)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * P2
        x = (x ^ (x >> np.uint64(29))) * P3
        return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words of one text, from the words' hashes, and where each begins."""
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    first = ranges(offsets[:-1], counts)
    with np.errstate(over="ignore"):
        out = np.zeros(len(first), np.uint64)
        for k in range(n):
            out = out * P1 + words[first + k]
        return mix64(out), first


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ``start[i], start[i] + 1, ...`` with ``count[i]`` numbers each."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) - np.repeat(before, count) + np.repeat(start, count)


def shingle_hashes(flat: pa.Array, offsets: np.ndarray, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each ``n``-word shingle joined by single spaces, and each text's offsets in them.

    A text with fewer words has one shingle of all its words, a text without words has none.
    """
    words = np.diff(offsets)
    counts = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    first = ranges(offsets[:-1], counts)
    last = np.minimum(first + n - 1, np.repeat(offsets[1:] - 1, counts))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")
    data, _, _ = raw(joined)
    length = raw(flat)[2]
    end = np.cumsum(length + 1) - 1
    start = end - length
    return xxh64(data, start[first], end[last] - start[first], seed), np.concatenate([[0], np.cumsum(counts)])
