"""Token counts by a separator scan over flat token files that have no index.

``write_token_files`` tokenises documents and writes, for each task, flat files of little-endian 16-bit ids in which an
end-of-document id follows each document, and flat files of the doc_ids in the same order, a byte before each saying whether
it is null.  Files hold at most ``FILE_DOCS`` documents and, but for the last of them, ``FILE_BYTES`` of ids, so one fits a task.  A task's files, in the order of their numbers, are one
stream: documents are numbered along it, so the two kinds need not break at the same document.  ``scan_token_files`` knows nothing
but the end id: files are searched block by block with vectorised comparisons; the blocks' boundaries are stitched by
prefix scans, the sum of the separators and the last separator's place in earlier blocks of the stream, so a document
may span any number of blocks.

Defined cases: a null or empty text has no tokens but its separator; tokens after a stream's last separator count
as one more document; an empty table gives no rows; repeated rows stay; null doc_ids come back as null; very long texts
are tokenised whole; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shared_folder
from .texts import id_and_text, one_array, slices

END = 50256  # free in the vocabulary
BLOCK = 1 << 20
FILE_DOCS = 20_000
FILE_BYTES = 64 << 20
#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict = {}


def encoding(path: str):
    """A byte-level encoding from a file of ranks, loaded once in a worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def write_token_files(docs: DataFrame, folder: str, ranks: str, file_bytes: int | None = None) -> None:
    """Flat files of ids under ``folder``/kind=tokens and of doc_ids under ``folder``/kind=ids, each in parts of bounded size."""
    limit = file_bytes or FILE_BYTES

    def run(batches):
        place, size = 0, 0
        for batch in slices(batches):
            encode = encoding(ranks).encode_ordinary
            tokens = [np.array(encode(t), "<u2").tobytes() for t in one_array(batch.column("text")).to_pylist()]
            ids = [bytes([x is None]) + (x or 0).to_bytes(8, "little", signed=True) for x in batch.column("doc_id").to_pylist()]
            n = len(ids)
            ends = size + np.cumsum([len(x) + 2 for x in tokens])
            part = np.concatenate([[size], ends[:-1]]) // limit
            size = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["ids"] * n + ["tokens"] * n),
                    pa.array(np.tile(part, 2), pa.int64()),
                    pa.array([*range(place, place + n)] * 2, pa.int64()),
                    pa.array(ids + tokens, pa.binary()),
                ],
                ["kind", "piece", "place", "value"],
            )
            place += n

    rows = id_and_text(docs).mapInArrow(run, "kind string, piece long, place long, value binary")
    end = END.to_bytes(2, "little").decode("latin-1")
    (
        rows.sortWithinPartitions("kind", "piece", "place")
        .select("kind", "piece", F.col("value").cast("string").alias("value"))
        .write.partitionBy("kind", "piece")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", end)
        .option("maxRecordsPerFile", FILE_DOCS)
        .text(folder)
    )


def _files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(stream, part, content): a task's files of a kind, and their number in it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    task = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    file = F.coalesce(F.expr(r"try_cast(regexp_extract(path, '\\.c(\\d+)(\\.[a-z]+)?$', 1) as long)"), F.lit(0).cast("long"))
    part = F.regexp_extract("path", r"/piece=(\d+)/", 1).cast("long") * (1 << 20) + file
    return found.filter(F.col("path").contains(f"/kind={kind}/")).select(task.alias("stream"), part.alias("part"), "content")


def scan_token_files(files: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """(stream, ordinal, n_tokens) of each document of streams of flat files given as (stream, part, content)."""
    schema = "stream long, part long, block long, ids long, ends array<long>"

    def run(batches):
        for batch in batches:
            for stream, part, content in zip(*(batch.column(x) for x in ("stream", "part", "content")), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                for k in range(0, len(ids), block):
                    some = ids[k : k + block]
                    row = [[stream.as_py()], [part.as_py()], [k // block], [len(some)]]
                    ends = pa.array([np.flatnonzero(some == end)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in row), ends], ["stream", "part", "block", "ids", "ends"])

    blocks = files.mapInArrow(run, schema)
    order = W.partitionBy("stream").orderBy("part", "block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("ids").over(earlier), F.lit(0))
    placed = blocks.select("*", begin.alias("begin"), F.lead("block").over(order).isNull().alias("final"))
    placed = placed.withColumn("stop", F.col("begin") + F.col("ids")).withColumn("ends", F.expr("transform(ends, e -> e + begin)"))
    # what follows the last separator of a stream is a document too
    open_end = F.expr("final and coalesce(get(ends, size(ends) - 1), -1) < stop - 1")
    placed = placed.withColumn("ends", F.when(open_end, F.concat("ends", F.array("stop"))).otherwise(F.col("ends")))
    placed = placed.select("stream", "part", "block", "ends")
    stitched = placed.select(
        "stream",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.expr("get(ends, size(ends) - 1)")).over(earlier), F.lit(-1)).alias("last"),
    )
    lengths = F.expr("transform(ends, (e, i) -> e - coalesce(get(ends, i - 1), last) - 1)")
    each = stitched.select("stream", "before", F.posexplode(lengths).alias("i", "n_tokens"))
    return each.select("stream", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens")


def _doc_ids(files: DataFrame) -> DataFrame:
    """(stream, ordinal, doc_id): the ids of a stream, numbered along its files."""
    record = np.dtype([("none", "u1"), ("id", "<i8"), ("end", "V2")])

    def run(batches):
        for batch in batches:
            for stream, part, content in zip(*(batch.column(x) for x in ("stream", "part", "content")), strict=True):
                some = np.frombuffer(content.as_buffer(), record)
                ids = pa.array([pa.array(some["id"].copy(), pa.int64(), mask=some["none"] == 1)], pa.list_(pa.int64()))
                row = (pa.array([x], pa.int64()) for x in (stream.as_py(), part.as_py(), len(some)))
                yield pa.RecordBatch.from_arrays([*row, ids], ["stream", "part", "n", "ids"])

    each = files.mapInArrow(run, "stream long, part long, n long, ids array<long>")
    earlier = W.partitionBy("stream").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = each.select("stream", "ids", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = placed.select("stream", "before", F.posexplode("ids").alias("i", "doc_id"))
    return rows.select("stream", (F.col("before") + F.col("i")).alias("ordinal"), "doc_id")


def token_counts(docs: DataFrame, ranks: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of each row of documents, by way of flat token files in the shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, ranks)
    counts = scan_token_files(_files(spark, folder, "tokens"), block=block)
    return counts.join(_doc_ids(_files(spark, folder, "ids")), ["stream", "ordinal"]).select("doc_id", "n_tokens")
