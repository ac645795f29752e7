"""Importance resampling towards a target distribution, in two Arrow passes.

A text's features are all its runs of one to ``LONGEST`` words, hashed by CRC-32 to ``BUCKETS`` buckets.  The first pass counts
buckets: each task adds ``np.bincount`` of its texts to one vector of ``BUCKETS`` numbers, and ``treeReduce`` merges the vectors
in three levels.  A bucket's gain is the log ratio of its smoothed shares in the target and in the documents.  The
second pass broadcasts the gains (``BUCKETS`` numbers), gathers them at the features' buckets and sums them for each document by
``np.bincount`` with weights.  Gumbel noise from the id turns weights into scores, and the highest scores are the draw: documents
are dealt to ranges of (score, id), sorted there, written, and numbered on from the sizes of the ranges.

The checksum of a run of words is put together from those of its words: shifting a checksum by so many bytes is linear
over its bits, so it is four look-ups in a table for that number of bytes.

Defined cases: a null or empty text has no words, no features and weight 0; null ids stay null, take their noise from the empty
string instead of the id and come last among equal scores; rows that repeat an id stay separate rows, each with its own rank;
an empty table gives no rows, an empty target counts nothing; only ``doc_id`` and ``text`` are read; texts are taken whole.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import task_count, written
from .texts import id_and_text, one_array, raw, slices

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
SHORT = 64
ROW_BYTES = 64
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = _lower()
#: Bytes of words once A-Z are lowered: digits, a-z, and all bytes of characters beyond ASCII.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


BYTE = _byte_table()


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Checksums shifted by four tables, one for each of their bytes."""
    out = tables[0][crc & 255]
    for k in range(1, 4):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & 255]
    return out


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables for shifts by 0 to ``SHORT`` bytes, and for shifts by 1, 2, 4, ... bytes."""
    each = np.arange(256, dtype=np.uint32)
    short = [np.stack([each << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT):
        short.append(BYTE[short[-1] & 255] ^ (short[-1] >> np.uint32(8)))
    doubled = [short[1]]
    for _ in range(40):
        doubled.append(_through(doubled[-1], doubled[-1]))
    return np.stack(short), np.stack(doubled)


SHIFT, DOUBLED = _shift_tables()
FLAT = SHIFT.ravel()


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums as they count once so many bytes follow; xor with the checksum of those bytes is that of the whole."""
    at = np.minimum(by, SHORT) * 1024
    out = FLAT[at + (crc & 255)]
    for k in range(1, 4):
        out ^= FLAT[at + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    far = np.flatnonzero(by > SHORT)
    if len(far):
        some, left = crc[far], by[far]
        for bit in range(int(left.max()).bit_length()):
            on = (left >> bit) & 1 == 1
            some = np.where(on, _through(DOUBLED[bit], some), some)
        out[far] = some
    return out


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices of one byte buffer: byte by byte over all short ones at once."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-length, kind="stable")
    n_long = int(np.searchsorted(-length[order], -SHORT, side="left"))
    at, left, crc = start[order[n_long:]], length[order[n_long:]], out[n_long:]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))
        crc[:n] = BYTE[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    result = np.empty_like(out)
    result[order] = ~out
    for i in order[:n_long]:
        result[i] = zlib.crc32(data[start[i] : start[i] + length[i]])
    return result


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of one, two, ... words their buckets and the texts they are in; and each text's number of words."""
    data, start, length = raw(texts)
    if not len(start) or not length.sum():
        return [], [], np.zeros(len(start), np.int64)
    base, edges = int(start[0]), start - start[0]
    data = LOWER[data[base : base + int(edges[-1] + length[-1])]]
    word = IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    at = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - at
    text = np.searchsorted(edges + length, at, side="right")
    crc = checksums(data, at, size)
    blank = shifted(np.full(len(at), zlib.crc32(b" "), np.uint32), size) ^ crc  # of the word with a blank before it
    found, owner, run, of = [(crc % np.uint32(buckets)).astype(np.int64)], [text], crc, text
    for n in range(1, longest):
        inside = of[: len(of) - 1] == text[n:]
        run = shifted(run[:-1], size[n:] + 1) ^ blank[n:]
        of = np.where(inside, of[:-1], -1)
        found.append((run[inside] % np.uint32(buckets)).astype(np.int64))
        owner.append(text[n:][inside])
    return found, owner, np.bincount(text, minlength=len(texts))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for some in features(one_array(batch.column("text")), buckets, longest)[0]:
                total += np.bincount(some, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    context = texts.sparkSession.sparkContext
    none = context.parallelize([np.zeros(buckets, np.int64)], 1)
    vectors = texts.select("text").mapInArrow(run, "counts binary").rdd.map(lambda row: np.frombuffer(row.counts, np.int64))
    return vectors.union(none).treeReduce(np.add, depth=3)


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, both counts raised by one."""
    n, own_all, target_all = len(own), float(own.sum()), float(target.sum())
    ratio = lambda t, s: (t + 1.0) * (own_all + n) / ((s + 1.0) * (target_all + n))
    return np.array([math.floor(1000 * math.log(ratio(t, s))) for t, s in zip(target.tolist(), own.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the sum of the gains of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64))

    def run(batches):
        gain = shared.value
        for batch in slices(batches):
            n = batch.num_rows
            found, owner, words = features(one_array(batch.column("text")), len(gain), longest)
            weight, count = np.zeros(n), np.zeros(n, np.int64)
            for buckets, texts in zip(found, owner, strict=True):
                weight += np.bincount(texts, weights=gain[buckets], minlength=n)
                count += np.bincount(texts, minlength=n)
            columns = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, count, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Thousandths of a Gumbel number that belongs to the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, order: list, n_rows: int, tag: str) -> DataFrame:
    """``rows`` with ``number`` from 1 in the order: ranges are sorted and written, and go on where the one before ends.

    Rows that are equal in the order are told apart by their place in ``rows``, which is best a written table, so a value that
    very many rows share still spreads over ranges.
    """
    spark = rows.sparkSession
    order = [*order, F.col("_place")]
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(task_count(spark, n_rows * ROW_BYTES), *order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(dealt.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", at).drop("_place"), tag)
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # one row for 32 MB
    first = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    starts = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, first, strict=False)], "_part int, _first long")
    return placed.join(F.broadcast(starts), "_part").withColumn("number", F.col("_first") + F.col("_at") + 1).drop("_part", "_at", "_first")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of documents; ``rank`` is null where it is not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn (rounded down), those of the highest scores.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    scored = weighed(docs, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "resampling")
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], n, "draw")
    rank = F.when(F.col("number") <= n * percent // 100, F.col("number"))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).drop("number").unionByName(rest)
