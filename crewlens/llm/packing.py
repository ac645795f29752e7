"""Packing along a space-filling curve.

A document's vector counts its pairs of neighbouring bytes, hashed to ``DIMS`` dimensions with signs and averaged; the
vector's place on a Hilbert curve is its key.  Keys are stored once beside the texts.  The curve is cut into ``PARTS`` equal parts,
whose bytes of text are summed; neighbouring parts make ranges of about ``TASK_BYTES``, and a part that is larger is dealt to several by
a hash.  Ranges are sorted by (key, doc_id, hash of the text), so that neighbours in a sequence are alike, long documents do not
meet in one task, and a third of all rows with one key still spreads.
Each partition tokenises its documents and cuts the running line of ids into sequences of ``SIZE``; the rest
at its end goes into sequences of powers of two, which need no padding.

Tokenising: white-space words are encoded once a batch, by the tokenizer itself.  Its pattern never crosses
white space, so the ids of a text are those of its words.  Words of letters followed by ASCII punctuation are
encoded as the two parts, which its pattern separates too.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as often as they occur; null
doc_ids come last among equal keys; an empty table gives no pieces; other columns are not read; a very long text is
cut over as many sequences as it takes.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import task_count, text_bytes, written
from .texts import id_and_text, one_array, ranges, raw, slices, split_words, string_hashes, word_codes

SIZE = 4096
END = 2
DIMS = 3
BITS = 16
PARTS = 1 << 16
CACHE_WORDS = 1 << 20
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PLAIN = r"^(?P<core>\p{L}+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


def byte_vectors(texts: pa.Array) -> np.ndarray:
    """Each text's signed, hashed and averaged counts of byte pairs, about normal in each dimension."""
    rng = np.random.default_rng(5)
    signs = rng.choice(np.array([-1, 1], np.int8), (DIMS, 1 << 16))
    data, start, length = raw(texts)
    out = np.zeros((len(start), DIMS))
    full = np.flatnonzero(length > 1)
    if len(full):
        base, end = int(start[0]), int(start[-1] + length[-1])
        some = data[base:end].astype(np.uint16)
        pairs = np.append(some[:-1] * np.uint16(256) + some[1:], np.uint16(0))
        first = start[full] - base
        for d in range(DIMS):
            value = signs[d][pairs].astype(np.int32)
            sums = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
            out[full, d] = (sums[first + length[full] - 1] - sums[first]) / np.sqrt(length[full] - 1)
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below 2^bits, by the transposed-index method."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve_keys(texts: pa.Array) -> np.ndarray:
    v = byte_vectors(texts)
    cells = np.clip((np.arctan(v / 8) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells, BITS)


class WordEncoder:
    """Ids of texts by a public tokenizer, remembering up to ``CACHE_WORDS`` words in sorted arrays, by 64 bits of hash."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words where their ids begin in ``self.ids``, and how many there are."""
        h = string_hashes(words)
        at = np.searchsorted(self.known, h)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != h) if len(self.known) else np.arange(len(h))
        if len(self.known) + len(new) > CACHE_WORDS and len(self.known):
            self.forget()
            return self.words(words)
        if len(new):
            self.learn(h[new], words.take(pa.array(new)).to_pylist())
            at = np.searchsorted(self.known, h)
        return self.first[at], self.size[at]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(size) - size
        self.used += len(ids)
        order = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[order])
        self.known, self.first, self.size = (np.insert(old, place, more[order]) for old, more in ((self.known, hashes), (self.first, first), (self.size, size)))

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words the ids laid end to end, and their numbers."""
        split = pc.extract_regex(words, PLAIN)
        odd = np.asarray(split.is_null())
        core = pc.if_else(pa.array(odd), words, pc.ascii_lower(pc.struct_field(split, "core")))
        tail = pc.if_else(pa.array(odd), "", pc.struct_field(split, "tail"))
        n = len(words)
        codes, distinct = word_codes(pa.concat_arrays([core, tail]))
        first, size = self.words(distinct)
        at = np.stack([first[codes[:n]], first[codes[n:]]], axis=1).ravel()
        m = np.stack([size[codes[:n]], size[codes[n:]]], axis=1)
        return self.ids[ranges(at, m.ravel())], m.sum(axis=1)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the texts' offsets."""
        flat, offsets = split_words(texts)
        n = len(offsets) - 1
        if not len(flat):
            return np.full(n, END, "<u4"), np.arange(n + 1)
        codes, words = word_codes(flat)
        ids, size = self.table(words)
        begin = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[codes])])[offsets]
        out = np.full(int(ends[-1]) + n, END, "<u4")
        place = np.ones(len(out), bool)
        place[ends[1:] + np.arange(n)] = False
        out[place] = ids[ranges(begin[codes], size[codes])]
        return out, ends + np.arange(n + 1)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def sequence_sizes(rest: int, size: int = SIZE) -> list[int]:
    """Sizes of the sequences for the last ids of a partition: full ones, then powers of two."""
    full, left = divmod(rest, size)
    return [size] * full + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


class _Line:
    """The running line of ids of a partition, cut into sequences."""

    def __init__(self, partition: int, size: int):
        self.sequence, self.size, self.pending, self.waiting = partition << 32, size, [], 0

    def pieces(self, ids: np.ndarray, doc: int, total: int) -> None:
        self.pending.append((doc, 0, ids, total))
        self.waiting += len(ids)

    def cut(self, sizes: list[int]) -> pa.RecordBatch:
        """Fill sequences of these sizes from what is pending."""
        cols: list[list[int]] = [[] for _ in range(7)]
        at = 0
        for size in sizes:
            filled = 0
            while filled < size:
                doc, start, ids, total = self.pending[at]
                take = min(size - filled, len(ids))
                row = (doc, start, take, zlib.crc32(ids[:take].tobytes()), total, self.sequence, filled)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                filled += take
                if take == len(ids):
                    at += 1
                else:
                    self.pending[at] = (doc, start + take, ids[take:], total)
            self.sequence += 1
            self.waiting -= size
        del self.pending[:at]
        names = [x.split()[0] for x in PIECE.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Pieces of documents in sequences; ``sequence_id`` is unique, not gapless; ``size`` is a power of two."""

    def keyed(batches):
        for batch in slices(batches):
            keys = pa.array(curve_keys(one_array(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([keys, *batch.columns], ["key", "doc_id", "text", "text_hash"])

    def pack(batches):
        line = _Line(TaskContext.get().partitionId(), size)
        for batch in slices(batches):
            ids, offsets = encoder(tokenizer).texts(one_array(batch.column("text")))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                line.pieces(ids[a:b], doc, b - a)
            yield line.cut([size] * (line.waiting // size))
        yield line.cut(sequence_sizes(line.waiting, size))

    near = written(id_and_text(docs, text_hash=True).mapInArrow(keyed, "key long, doc_id long, text string, text_hash long"), "curve")
    ranges_ = near.join(F.broadcast(curve_ranges(near)), F.shiftright("key", DIMS * BITS - 16) == F.col("part"))  # at most PARTS rows
    owner = F.col("first") + F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("tasks")).cast("int")
    order = (F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("text_hash"))
    dealt = ranges_.select("key", "doc_id", "text", "text_hash", owner.alias("owner"))
    n = task_count(docs.sparkSession, text_bytes(near)) + 1
    return dealt.repartitionById(n, F.least("owner", F.lit(n - 1))).drop("owner").sortWithinPartitions(*order).mapInArrow(pack, PIECE)


def curve_ranges(near: DataFrame) -> DataFrame:
    """(part, first, tasks): of each part of the curve that is in use the first task that gets it, and how many do."""
    spark = near.sparkSession
    size = F.sum(F.octet_length("text") + F.lit(64)).alias("size")
    found = near.groupBy(F.shiftright("key", DIMS * BITS - 16).alias("part")).agg(size).orderBy("part").toPandas()  # at most PARTS rows
    ends = found["size"].to_numpy(np.int64).cumsum()
    n = task_count(spark, int(ends[-1]) if len(ends) else 0)
    per = max(1.0, (int(ends[-1]) if len(ends) else 0) / n)
    found["first"] = ((ends - found["size"].to_numpy(np.int64)) // per).astype(np.int32)
    found["tasks"] = np.maximum(1, np.ceil(found["size"].to_numpy(np.int64) / per)).astype(np.int32)
    return spark.createDataFrame(found[["part", "first", "tasks"]], "part long, first int, tasks int")
