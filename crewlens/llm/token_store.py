"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt to ranges of ids and sorted there; a task encodes its documents one after another and cuts the line of ids into
blocks of ``BLOCK``.  Of a block the least id is subtracted, the rest is packed at the width that ``PERCENTILE`` of its values fit, and
the values that do not fit stand in a list of exceptions.  A file is closed after the document with which it has ``FILE_IDS`` ids.

File format, numbers little-endian unless said otherwise:

* blocks: groups of 64 ids packed to ``width`` words of 64 bits, lowest bits first; then the places (16 bits) of the exceptions, and
  their values less the block's least id (32 bits);
* documents: null mark (1 byte), doc_id (signed 64 bits), number of ids (64 bits);
* index of blocks: where the block starts (64 bits), least id (32), width (8), number of exceptions (16);
* numbers of ids, documents and blocks (64 bits each, big-endian), and the four bytes ``PFR1``.

The file's last 28 bytes thus lead to everything, and one block can be read without those before it.  Files are read by their
names' order, which is that of the ids; a file's first id is found by prefix sums over the files' last bytes, in three levels, so no task
gets a row for each file.

Defined cases: a null or empty text is the end id alone; null doc_ids come last; rows that repeat an id stay separate, in the order of the
table's files; a text that itself holds the end id keeps it, since documents are told apart by their number of ids; an empty table gives no
files and no rows; other columns are not read; texts are taken whole, and a document is never cut over two files.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .packing import encoder
from .shared import shared_folder, task_count, text_bytes, written
from .texts import id_and_text, one_array, slices

BLOCK = 1024
LANES = 64
PERCENTILE = 90
FILE_IDS = 1 << 24
CHUNK = 1024
MAGIC = b"PFR1"
TAIL = 28
NEAR = 1024
DOCUMENT = np.dtype([("none", "u1"), ("doc_id", "<i8"), ("n", "<u8")])
ENTRY = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("odd", "<u2")])
ODD = 6  # bytes of an exception


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 numbers as rows of ``width`` words; higher bits are left out."""
    out = np.zeros((len(values), width), np.uint64)
    if width:
        some = values.astype(np.uint64) & np.uint64((1 << width) - 1)
        for i in range(LANES):
            word, bit = divmod(i * width, 64)
            out[:, word] |= some[:, i] << np.uint64(bit)
            if bit + width > 64:
                out[:, word + 1] |= some[:, i] >> np.uint64(64 - bit)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The rows of 64 numbers that ``pack`` took."""
    out = np.zeros((len(words), LANES), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANES if width else 0):
        word, bit = divmod(i * width, 64)
        some = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            some = some | words[:, word + 1] << np.uint64(64 - bit)
        out[:, i] = some & mask
    return out


def widths(values: np.ndarray, percentile: int) -> np.ndarray:
    """Bits that so many in a hundred values of each row fit in."""
    at = min(values.shape[1] - 1, -(-values.shape[1] * percentile // 100) - 1)
    limit = np.partition(values, at, axis=1)[:, at]
    return np.frexp(limit.astype(np.float64))[1].astype(np.int64)


def encoded_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[list[bytes], np.ndarray]:
    """Bytes and index entries (starts still 0) of blocks of ``BLOCK`` ids; the last may be shorter and is filled up with its least id."""
    n = -(-len(ids) // BLOCK)
    full = np.zeros(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    if len(ids) < len(full):
        full[len(ids) :] = full[(n - 1) * BLOCK : len(ids)].min()
    values = full.reshape(n, BLOCK)
    entries = np.zeros(n, ENTRY)
    entries["least"] = values.min(axis=1)
    values = values - entries["least"][:, None]
    width = widths(values, percentile)
    entries["width"] = width
    odd = values >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    entries["odd"] = odd.sum(axis=1)
    row, place = np.nonzero(odd)
    edges = np.concatenate([[0], np.cumsum(entries["odd"], dtype=np.int64)]).tolist()
    places, high = place.astype("<u2"), values[row, place].astype("<u4")
    parts: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        words = pack(values[of].reshape(-1, LANES), w).reshape(len(of), -1)
        for k, some in zip(of.tolist(), words, strict=True):
            a, b = edges[k], edges[k + 1]
            parts[k] = some.tobytes() + places[a:b].tobytes() + high[a:b].tobytes()
    return parts, entries


@dataclass
class FileWriter:
    """One file in the making: whole blocks are packed as soon as there are enough of them."""

    percentile: int = PERCENTILE
    n_ids: int = 0
    parts: list[bytes] = field(default_factory=list)
    entries: list[np.ndarray] = field(default_factory=list)
    documents: list[tuple] = field(default_factory=list)
    waiting: list[np.ndarray] = field(default_factory=list)
    n_waiting: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id is None, doc_id or 0, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BLOCK * CHUNK:
            self._encode(self.n_waiting // BLOCK * BLOCK)

    def _encode(self, n: int) -> None:
        line = np.concatenate(self.waiting)
        for a in range(0, n, BLOCK * CHUNK):
            parts, entries = encoded_blocks(line[a : min(n, a + BLOCK * CHUNK)], self.percentile)
            self.parts += parts
            self.entries.append(entries)
        self.waiting, self.n_waiting = [line[n:].copy()], len(line) - n

    def finished(self) -> bytes:
        """The file but for its magic bytes."""
        if self.n_waiting:
            self._encode(self.n_waiting)
        entries = np.concatenate(self.entries)
        size = np.array([len(x) for x in self.parts], np.uint64)
        entries["start"] = np.cumsum(size) - size
        counts = np.array([self.n_ids, len(self.documents), len(entries)], ">u8")
        return b"".join([*self.parts, np.array(self.documents, DOCUMENT).tobytes(), entries.tobytes(), counts.tobytes()])


class FileReader:
    """A file's documents and blocks, from its last bytes on."""

    def __init__(self, content):
        self.data = np.frombuffer(content, np.uint8)
        if self.data[-4:].tobytes() != MAGIC:
            raise ValueError("not a token file")
        end = len(self.data) - TAIL
        self.n_ids, n_docs, n_blocks = self.data[end:-4].view(">u8").tolist()
        begin = end - n_blocks * ENTRY.itemsize
        self.entries = np.frombuffer(self.data[begin:end].tobytes(), ENTRY)
        self.documents = np.frombuffer(self.data[begin - n_docs * DOCUMENT.itemsize : begin].tobytes(), DOCUMENT)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last``, the latter left out."""
        entries = self.entries[first:last]
        out = np.empty((len(entries), BLOCK), np.uint32)
        start, width, odd = (entries[x].astype(np.int64) for x in ("start", "width", "odd"))
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            size = BLOCK // 8 * w
            at = (start[of][:, None] + np.arange(size)).ravel()
            out[of] = unpack(self.data[at].view("<u8").reshape(-1, w) if w else np.zeros((len(of) * BLOCK // LANES, 0), np.uint64), w).reshape(-1, BLOCK)
        for k in np.flatnonzero(odd).tolist():
            a = int(start[k]) + BLOCK // 8 * int(width[k])
            b = a + 2 * int(odd[k])
            places = self.data[a:b].view("<u2") if a % 2 == 0 else np.frombuffer(self.data[a:b].tobytes(), "<u2")
            out[k, places] = np.frombuffer(self.data[b : b + 4 * int(odd[k])].tobytes(), "<u4")
        out += entries["least"][:, None]
        return out.ravel()[: max(0, min(self.n_ids, last * BLOCK) - first * BLOCK)]

    def ids(self) -> np.ndarray:
        out = np.empty(self.n_ids, "<u4")
        for a in range(0, len(self.entries), CHUNK):
            out[a * BLOCK : (a + CHUNK) * BLOCK] = self.blocks(a, min(a + CHUNK, len(self.entries)))
        return out


def write_token_store(docs: DataFrame, folder: str, tokenizer: str, file_ids: int = FILE_IDS, percentile: int = PERCENTILE) -> None:
    """Files of the documents' ids under ``folder``, in ascending order of doc_id, each document with the end id."""

    def run(batches):
        out = FileWriter(percentile)
        for batch in slices(batches):
            ids, offsets = encoder(tokenizer).texts(one_array(batch.column("text")))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.add(doc, ids[a:b])
                if out.n_ids >= file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([out.finished()], pa.binary())], ["value"])
                    out = FileWriter(percentile)
        if out.documents:
            yield pa.RecordBatch.from_arrays([pa.array([out.finished()], pa.binary())], ["value"])

    read = id_and_text(docs)
    n = task_count(docs.sparkSession, text_bytes(read))
    order = (F.col("doc_id").asc_nulls_last(), F.col("place"))  # a place for each row: one id may be on any number of rows
    dealt = read.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    files = dealt.drop("place").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(task, part, content) of all files; by these numbers they are in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    task = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    part = F.coalesce(F.expr(r"try_cast(regexp_extract(path, '\\.c(\\d+)(\\.[a-z]+)?$', 1) as long)"), F.expr(r"try_cast(regexp_extract(path, '-c(\\d+)\\.[a-z]+$', 1) as long)"), F.lit(0).cast("long"))
    return found.filter("length > 0").select(task.alias("task"), part.alias("part"), "content")


def file_starts(files: DataFrame) -> DataFrame:
    """(task, part, first): how many ids stand in the files before each, from the files' last bytes.

    Sums run within tasks, within groups of ``NEAR`` tasks, and over the groups, so the one task that sums groups gets a row for
    ``NEAR`` tasks.
    """
    n_ids = F.conv(F.hex(F.expr(f"substring(content, length(content) - {TAIL - 1}, 8)")), 16, 10).cast("long")
    each = files.select("task", "part", n_ids.alias("n"), F.floor(F.col("task") / NEAR).alias("near"))
    each = written(each, "token-files")  # a row a file
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = each.groupBy("near", "task").agg(F.sum("n").alias("n"))
    groups = tasks.groupBy("near").agg(F.sum("n").alias("n"))
    group_first = groups.select("near", earlier(W.orderBy("near")).alias("c"))
    task_first = tasks.select("near", "task", earlier(W.partitionBy("near").orderBy("task")).alias("b"))
    within = each.select("near", "task", "part", earlier(W.partitionBy("near", "task").orderBy("part")).alias("a"))
    whole = within.join(task_first, ["near", "task"]).join(group_first, "near")
    return whole.select("task", "part", (F.col("a") + F.col("b") + F.col("c")).alias("first"))


def read_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    schema = "task long, part long, doc_id long, at long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for task, part, content in zip(*(batch.column(x) for x in ("task", "part", "content")), strict=True):
                file = FileReader(content.as_buffer())
                ids, docs = memoryview(file.ids()).cast("B"), file.documents
                n = docs["n"].astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                doc_id = pa.array(docs["doc_id"].copy(), pa.int64(), mask=docs["none"] == 1)
                same = (pa.array(np.full(len(n), x.as_py(), np.int64)) for x in (task, part))
                yield pa.RecordBatch.from_arrays([*same, doc_id, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], ["task", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = _files(spark, folder)
    each = files.mapInArrow(run, schema).join(file_starts(files), ["task", "part"])
    return each.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str, file_ids: int = FILE_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of documents, by way of files in the shared folder."""
    folder = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_token_store(docs, folder, tokenizer, file_ids)
    return read_token_store(docs.sparkSession, folder)
