"""Blocks of documents that send packed keys to ranges of the key space and get one bit a key back.

Rows of the exchange hold many keys each, so that windows of words, far more numerous than words, cost bytes and not
rows.  A block meets every second range at most, so with b blocks there are b * b / 2 payloads at first; from about a
million keys a block on (8 MB of text), each holds fewer keys, down to one, and the exchange is one of plain keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import task_count, text_bytes, written
from .texts import id_and_text

BLOCK_BYTES = 8 << 20
SMALL_BLOCK_BYTES = 1 << 20
MOST_COPIES = 1_000

Replies = dict[int, bytes]
Send = Callable[..., list[tuple[int, bytes]]]
Answer = Callable[[list[bytes]], list[bytes | None]]


class Blocks:
    """(doc_id, text, copies, block): documents dealt by a hash of id and text into blocks of about ``block_bytes`` of text.

    Small corpora get smaller blocks, of a megabyte at least, up to two for each core.  Equal rows, which have one hash, would meet in a
    block however many they are; of rows that occur more than ``MOST_COPIES`` times one is kept with their number in ``copies``.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        read, spark = id_and_text(docs), docs.sparkSession
        self.bytes = text_bytes(read)
        small = min(2 * spark.sparkContext.defaultParallelism, -(-self.bytes // SMALL_BLOCK_BYTES))
        self.count = max(1, small, -(-self.bytes // block_bytes))
        #: A range then gets about as much as two blocks send.
        self.ranges = max(1, self.count // 2)
        self.tasks = task_count(spark, self.bytes)
        key = F.xxhash64("doc_id", "text")
        block = F.pmod(key, F.lit(self.count)).cast("int")
        self.frame = self._once(read.withColumn("_key", key)).withColumn("block", block).repartition(self.tasks, "block")

    def _once(self, rows: DataFrame) -> DataFrame:
        """Rows with ``copies``: one of those that are very often there, by a sum before the exchange, and all others as they are."""
        counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = written(counts.filter(F.col("n") > max(MOST_COPIES, total // 10_000)).select("_key"), "often")  # fewer than 10,000
        one = F.lit(1).cast("long").alias("copies")
        if not often.count():
            return rows.select("doc_id", "text", one)
        others = rows.join(F.broadcast(often), "_key", "left_anti").select("doc_id", "text", one)
        return others.unionByName(rows.join(F.broadcast(often), "_key", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")))

    def exchange(self, send: Send, answer: Answer, earlier: DataFrame | None = None) -> DataFrame:
        """Blocks send sorted keys by ranges; each range answers all its blocks at once.

        ``send`` gets a block's documents (and its earlier answers) and returns one payload for each range; ``answer``
        gets a range's payloads from all blocks and returns one answer to each, or None.  A key is sent once by each
        block however often it occurs there, so a key that holds a third of all rows gives no more than one entry a block.
        """
        schema = "range int, block int, payload binary"

        def alone(docs: pa.Table) -> pa.Table:
            return payloads(docs.column("block")[0].as_py(), send(docs))

        def joined(docs: pa.Table, before: pa.Table) -> pa.Table:
            return payloads(docs.column("block")[0].as_py(), send(docs, before)) if docs.num_rows else payloads(0, [])

        def answered(rows: pa.Table) -> pa.Table:
            replies = answer([x.as_buffer().to_pybytes() for x in rows.column("payload")])
            blocks, span = rows.column("block").to_pylist(), rows.column("range")[0].as_py()
            kept = [i for i, x in enumerate(replies) if x is not None]
            return pa.table(
                {
                    "block": pa.array([blocks[i] for i in kept], pa.int32()),
                    "range": pa.array([span] * len(kept), pa.int32()),
                    "payload": pa.array([replies[i] for i in kept], pa.binary()),
                }
            )

        if earlier is None:
            sent = self.frame.groupBy("block").applyInArrow(alone, schema)
        else:
            sent = self.frame.groupBy("block").cogroup(self._dealt(earlier)).applyInArrow(joined, schema)
        return sent.repartition(self.tasks, "range").groupBy("range").applyInArrow(answered, "block int, range int, payload binary")

    def finished(self, answers: DataFrame, finish: Callable[[pa.Table, Replies], pa.Table], schema: str) -> DataFrame:
        """Documents of a block with the answers to that block."""

        def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
            return finish(docs, by_key(replies))

        return self.frame.groupBy("block").cogroup(self._dealt(answers)).applyInArrow(run, schema)

    def _dealt(self, answers: DataFrame):
        return answers.repartition(self.tasks, "block").groupBy("block")


def by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of equal width of 64-bit keys that occur among sorted keys, and the borders between them."""
    owner = range_of(keys, ranges)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    edges = np.concatenate([[0], cuts, [len(keys)]]).astype(np.int64)
    return owner[edges[:-1]] if len(keys) else owner, edges


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def payloads(block: int, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        {
            "range": pa.array([p for p, _ in parts], pa.int32()),
            "block": pa.array([block] * len(parts), pa.int32()),
            "payload": pa.array([x for _, x in parts], pa.binary()),
        }
    )


def by_key(replies: pa.Table) -> Replies:
    return dict(zip(replies.column("range").to_pylist(), replies.column("payload").to_pylist(), strict=True))


RANK = np.dtype([("none", "u1"), ("id", "<i8")])
ENTRY = 16 + RANK.itemsize


def _first_rows(h1: np.ndarray, h2: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and id in which null ids come last, and where a key begins in it."""
    order = np.lexsort((ranks["id"], ranks["none"], h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


class Keys:
    """Rows' 128-bit keys grouped, with the smallest id of each key, in the order in which they are sent."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, ranks: np.ndarray):
        order, new = _first_rows(h1, h2, ranks)
        self.h1, self.h2, self.least = h1[order][new], h2[order][new], ranks[order][new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.late = ranks != self.least[self.group]

    @staticmethod
    def rank(ids) -> np.ndarray:
        """Ids as they are ordered, with a mark for nulls."""
        out = np.zeros(len(ids), RANK)
        out["none"] = np.asarray(ids.is_null())
        out["id"] = np.asarray(ids.fill_null(0))
        return out

    def parts(self, n: int) -> list[tuple[int, bytes]]:
        owner, edges = by_range(self.h1, n)
        spans = zip(owner.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True) if len(self.h1) else ()
        return [(r, self.h1[a:b].tobytes() + self.h2[a:b].tobytes() + self.least[a:b].tobytes()) for r, a, b in spans]

    def flags(self, replies: Replies, n: int) -> np.ndarray:
        """One bit a key, from the answers of all ranges."""
        out = np.zeros(len(self.h1), bool)
        owner, edges = by_range(self.h1, n)
        if len(self.h1):
            for r, a, b in zip(owner.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if r in replies:
                    out[a:b] = np.unpackbits(np.frombuffer(replies[r], np.uint8), count=b - a)
        return out


def seen_before(parts: list[bytes]) -> list[np.ndarray]:
    """For each block's keys of one range: whether another block has the key with a smaller id."""
    sizes = [len(p) // ENTRY for p in parts]
    h1, h2 = (np.concatenate([np.frombuffer(p, np.uint64, n, 8 * n * k) for p, n in zip(parts, sizes, strict=True)]) for k in range(2))
    least = np.concatenate([np.frombuffer(p, RANK, n, 16 * n) for p, n in zip(parts, sizes, strict=True)])
    order, new = _first_rows(h1, h2, least)
    ids = least[order]
    first = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.empty(len(order), bool)
    late[order] = ids != first
    return np.split(late, np.cumsum(sizes)[:-1])


def bits_or_none(flags: np.ndarray) -> bytes | None:
    return np.packbits(flags).tobytes() if flags.any() else None
