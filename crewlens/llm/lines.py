"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed; keep bitmaps.

Documents give one row (hash, doc_id, position) for each distinct key of a line; inside a batch of documents a key is asked
only for the smallest doc_id, since all others there are late whatever the rest of the corpus holds, so a line that is
in every document costs one row a batch.  Hashes are dealt to ranges of equal width (they are uniform, so no sampling is
needed), sorted by (hash, document, position), and one pass streams over each range with the last key and its first
document as its only state.  What comes back is positions: they become one bit string a document, compressed as run lengths.
No text moves but to be joined with its bits.

Defined cases: a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` always stay; all lines
of a key stay in the smallest doc_id that holds it, also in rows that repeat that id; a null doc_id counts as the largest id;
an empty table gives an empty result; very long texts are taken whole; other columns are not touched.  Keys are
compared by 128 bits of two seeded XXH64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import Keys
from .shared import task_count, text_bytes
from .texts import id_and_text, one_array, raw, same_row, slices, xxh64

MIN_CHARS = 10
BLANKS = " \t\n\x0b\x0c\r"
ASKED = "sure boolean, h1 long, h2 long, doc_id long, text_hash long, place int"


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return lists.flatten(), offsets - offsets[0]


def _trimmed(lines: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))


def _asked(min_chars: int):
    """Rows of ``ASKED``: keys to be looked up, and, with ``sure``, lines that are late inside their batch."""

    def run(batches):
        for batch in slices(batches):
            lines, offsets = _lines(one_array(batch.column("text")))
            trimmed = _trimmed(lines)
            at = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(trimmed), min_chars)))
            data, start, length = raw(trimmed)
            h1, h2 = (xxh64(data, start[at], length[at], seed) for seed in (42, 7))
            doc = np.searchsorted(offsets, at, side="right") - 1
            keys = Keys(h1, h2, Keys.rank(batch.column("doc_id"))[doc])
            _, first = np.unique(keys.group * batch.num_rows + doc, return_index=True)  # the first place of a key in a row
            first.sort()
            sure, doc, place = keys.late[first], doc[first], (at - offsets[doc])[first]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sure),
                    pa.array(h1[first].view(np.int64)),
                    pa.array(h2[first].view(np.int64)),
                    batch.column("doc_id").take(rows),
                    batch.column("text_hash").take(rows),
                    pa.array(place.astype(np.int32)),
                ],
                [x.split()[0] for x in ASKED.split(",")],
            )

    return run


def _late(batches):
    """Streams over a range's rows, sorted: (doc_id, text_hash, place) of all but the first document of each key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sure = np.asarray(batch.column("sure"))
        h1, h2 = np.asarray(batch.column("h1")), np.asarray(batch.column("h2"))
        rank = Keys.rank(batch.column("doc_id"))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (sure[1:] != sure[:-1])
        first = rank[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        if last is not None and last[:3] == (bool(sure[0]), int(h1[0]), int(h2[0])):
            begun = np.cumsum(new) == 1  # the key goes on from the batch before
            first[begun] = last[3]
        late = pa.array(sure | (rank != first))
        last = (bool(sure[-1]), int(h1[-1]), int(h2[-1]), first[-1])
        yield pa.RecordBatch.from_arrays([batch.column(x).filter(late) for x in ("doc_id", "text_hash", "place")], ["doc_id", "text_hash", "place"])


def dropped_places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_id, _hash, places): of rows of documents that lose lines, the first place of each key that goes."""
    read = id_and_text(docs, text_hash=True)
    n = task_count(docs.sparkSession, text_bytes(read))
    wide = F.when(F.col("sure"), F.col("text_hash")).otherwise(F.col("h1"))
    owner = F.shiftright(F.shiftrightunsigned(wide, 32) * F.lit(n), 32).cast("int")  # range n of equal width
    dealt = read.mapInArrow(_asked(min_chars), ASKED).repartitionById(n, owner)
    order = ("sure", "h1", "h2", F.col("doc_id").asc_nulls_last(), "place")
    late = dealt.sortWithinPartitions(*order).mapInArrow(_late, "doc_id long, text_hash long, place int")
    return late.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("place").alias("places"))


def _kept(texts: pa.Array, places: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines, the texts' offsets in them, and which stay: a line goes with the place of its key."""
    lines, offsets = _lines(texts)
    keep = np.ones(len(lines), bool)
    n = np.asarray(pc.fill_null(pc.list_value_length(places), 0), dtype=np.int64)
    some = np.flatnonzero(n)
    if len(some):
        size = np.diff(offsets)[some]
        owner = np.repeat(np.arange(len(some)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[some], size)
        codes = np.asarray(_trimmed(lines.take(pa.array(at))).dictionary_encode().indices, dtype=np.int64)
        code = owner * (int(codes.max()) + 1) + codes
        gone = np.repeat(np.cumsum(size) - size, n[some]) + np.asarray(places.take(pa.array(some)).flatten(), dtype=np.int64)
        keep[at] = ~np.isin(code, code[gone])
    return lines, offsets, keep


def _kept_texts(lines: pa.Array, offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines.filter(pa.array(keep)))
    return pc.binary_join(lists, "\n")


def _runs(offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Of each text the lengths of the runs of equal bits; a first run of 0 where its first bit is not set."""
    begin = np.zeros(len(keep), bool)
    begin[1:] = keep[1:] != keep[:-1]
    begin[offsets[:-1]] = True  # every text has a line
    at = np.flatnonzero(begin)
    length = np.diff(np.append(at, len(keep)))
    head = np.searchsorted(at, offsets[:-1])  # the first run of each text
    without = head[~keep[offsets[:-1]]]
    ends = np.append(head, len(at)) + np.concatenate([[0], np.cumsum(~keep[offsets[:-1]])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.insert(length, without, 0), pa.int32()))


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep_bitmap, kept_sha256) for each row of documents.

    ``keep_bitmap`` has the bits of the lines as run lengths, those that stay first (``unpack_bitmap``); ``kept_sha256`` is the digest of the lines that stay, joined by newlines.
    """

    def run(batches):
        for batch in slices(batches):
            lines, offsets, keep = _kept(one_array(batch.column("text")), batch.column("places"))
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in _kept_texts(lines, offsets, keep)]
            n = np.diff(offsets)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(kept), pa.int64()), _runs(offsets, keep), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])

    read, gone = id_and_text(docs), dropped_places(docs, min_chars)
    both = read.join(gone, same_row(read, gone, "_id", "_hash"), "left").select("doc_id", "text", "places")
    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep_bitmap array<int>, kept_sha256 string")


def unpack_bitmap(runs: list[int]) -> list[bool]:
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs).tolist()


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, all columns, with repeated lines taken out of their texts; ``n_chars`` follows if it is there."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text")
            new = _kept_texts(*_kept(one_array(texts), batch.column("places")))
            new = pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), new)
            yield pa.RecordBatch.from_arrays([new, batch.column("row")], ["text", "row"])

    gone = dropped_places(docs, min_chars)
    row = F.struct(*[docs[x] for x in docs.columns if x != "text"]).alias("row")
    both = docs.join(gone, same_row(docs, gone, "_id", "_hash"), "left").select(docs["text"], row, "places")
    out = both.mapInArrow(run, T.StructType([both.schema["text"], both.schema["row"]])).select("text", "row.*")
    sized = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[sized if x == "n_chars" else F.col(x) for x in docs.columns])
