"""Hard negatives from embeddings by a vector-approximation file.

Vectors are cut into blocks of about ``BLOCK_BYTES`` as they are read, without a shuffle.  In each block every dimension is quantised into
``CELLS`` cells of about equally many values, with the least and largest value of each cell; two dimensions' cells make one byte.
An anchor makes a table for each byte, with the least and the largest that any of the byte's two cells can add to the score; looking a
row's bytes up in the tables and adding gives bounds of its score.  Only rows whose bounds say that they may enter a window are
scored exactly: for positives, rows of the anchor's label that may be among its best; for negatives, rows of other labels whose score may
lie between the shares of a positive's score and be among the highest of these.  What a task has found so far in earlier blocks raises the bar
for later ones.  Nothing is left out: every anchor meets every row's approximation.

Anchors are packed into blocks too.  Each block of anchors meets each block of rows once, by an equality join on (block of anchors,
group of blocks of rows); tasks send on the few best of each window, which are ranked by Spark's windows, whose group limit drops the rest
before the exchange.  Work is anchors x rows / blocks of both, in tasks of bounded size.

Defined cases: rows with a null label, a null vector, or any null or non-finite component take no part.  A vector shorter than others
counts as ending in zeros; an empty one scores 0 with all.  Scaled components beyond +-2^27 count as +-2^27, so that sums of 500 products fit a
long.  A null vec_id is no anchor; as a row it takes part and comes last among equal scores.  Repeated rows are rows of their own, each an
anchor where its id says so; an anchor leaves out itself, once, and not its copies.  An anchor without positives, or a positive with nothing in
its window (among others, any positive with a negative score), gives no rows.  An empty table gives none.  Other columns are not read.
"""

from __future__ import annotations

from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

BLOCK_BYTES = 4 << 20
CELLS = 16
LIMIT = 1 << 27
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW_SHARE, HIGH_SHARE = 50, 95
BLOCKS_A_TASK = 8
NO_ID = np.iinfo(np.int64).max

ROWS = "dims int, n int, ids binary, none binary, labels binary, vectors binary, codes binary, low binary, high binary"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector): whole numbers of the rows that take part, as 32-bit integers, little-endian."""

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            flat = lists.flatten()
            values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")), dtype=np.float64)
            bad = ~np.isfinite(values)
            whole = np.clip(np.floor(np.where(bad, 0, values) * scale), -LIMIT, LIMIT).astype("<i4")
            edges = np.concatenate([[0], np.cumsum(size)])
            n_bad = np.concatenate([[0], np.cumsum(bad)])
            keep = n_bad[edges[1:]] == n_bad[edges[:-1]]
            rows = np.flatnonzero(keep)
            vector = [whole[edges[i] : edges[i + 1]].tobytes() for i in rows.tolist()]
            chosen = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([chosen.column("vec_id"), chosen.column("label"), pa.array(vector, pa.binary())], ["vec_id", "label", "vector"])

    read = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    there = read.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return there.mapInArrow(run, "vec_id long, label long, vector binary")


def matrix(vectors: list[bytes]) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    dims = max((len(v) for v in vectors), default=0) // 4
    if all(len(v) == 4 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), "<i4")
    for row, v in zip(out, vectors, strict=True):
        row[: len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def quantised(values: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's cells, two dimensions a byte, and the least and largest value of each dimension's cells.

    Cells hold about equally many values; equal values share a cell.  A last odd dimension is paired with one of zeros.
    """
    n, dims = values.shape
    even = dims + dims % 2
    codes = np.zeros((n, even), np.uint8)
    low, high = np.zeros((even, cells), np.int64), np.zeros((even, cells), np.int64)
    ordered = np.sort(values, axis=0)
    for d in range(dims):
        borders = ordered[[k * n // cells for k in range(1, cells)], d]
        codes[:, d] = np.searchsorted(borders, values[:, d], side="right")
        at = np.searchsorted(ordered[:, d], np.concatenate([borders, [ordered[-1, d] + 1]]), side="left")
        first = np.concatenate([[0], at[:-1]])
        used = at > first
        low[d, used], high[d, used] = ordered[first[used], d], ordered[at[used] - 1, d]
    return codes[:, 0::2] * np.uint8(cells) + codes[:, 1::2], low, high


def blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows packed into blocks, sorted by label within each, with their approximations."""

    def block(ids: list, labels: list, vectors: list[bytes]) -> pa.RecordBatch:
        label = np.array(labels, np.int64)
        order = np.argsort(label, kind="stable")
        values = matrix([vectors[i] for i in order.tolist()])
        codes, low, high = quantised(values)
        none = np.array([ids[i] is None for i in order.tolist()], np.uint8)
        own = np.array([NO_ID if ids[i] is None else ids[i] for i in order.tolist()], np.int64)
        binary = (x.tobytes() for x in (own, none, label[order], values, codes, low, high))
        columns = [pa.array([values.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in binary)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROWS.split(", ")])

    def run(batches):
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("vec_id", "label", "vector")), strict=True):
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                size += len(row[2]) + 24
                if size >= block_bytes:
                    yield block(*held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield block(*held)

    return rows.mapInArrow(run, ROWS)


class Block:
    """A block of rows, and bounds and exact scores of an anchor with them."""

    def __init__(self, row: dict):
        n, self.dims = row["n"], row["dims"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.n, self.ids, self.none, self.labels = n, read("ids", np.int64), read("none", np.uint8), read("labels", np.int64)
        self.values = read("vectors", "<i4").reshape(n, self.dims)
        even = self.dims + self.dims % 2
        self.codes = np.ascontiguousarray(read("codes", np.uint8).reshape(n, even // 2).T.astype(np.intp))
        self.low, self.high = (read(x, np.int64).reshape(even, CELLS) for x in ("low", "high"))
        self.widest = int(np.abs(self.values).max(initial=0))
        self.floats: np.ndarray | None = None

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, side="left")), int(np.searchsorted(self.labels, label, side="right"))

    def bounds(self, anchor: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest scores that rows ``first`` to ``last`` can have, by their cells."""
        own = np.zeros(len(self.low), np.int64)
        shared = min(self.dims, len(anchor))
        own[:shared] = anchor[:shared]
        a, b = self.low * own[:, None], self.high * own[:, None]
        each = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=-1)  # dimension, cell, least and largest
        tables = (each[0::2, :, None, :] + each[1::2, None, :, :]).reshape(-1, CELLS * CELLS, 2)
        total = np.zeros((last - first, 2), np.int64)
        part = np.empty_like(total)
        for table, codes in zip(tables, self.codes[:, first:last], strict=True):
            np.take(table, codes, axis=0, out=part, mode="clip")
            total += part
        return total[:, 0], total[:, 1]

    def exact(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole scores of the rows, by floating-point products where these are exact."""
        shared = min(self.dims, len(anchor))
        own = anchor[:shared].astype(np.int64)
        if self.widest * int(np.abs(own).max(initial=0)) * max(shared, 1) < 1 << 52:
            if self.floats is None:
                self.floats = self.values.astype(np.float64)
            return (self.floats[rows, :shared] @ own.astype(np.float64)).astype(np.int64)
        return self.values[rows, :shared].astype(np.int64) @ own


def highest(values: np.ndarray, k: int) -> int:
    """The k-th largest value."""
    return int(np.partition(values, len(values) - k)[len(values) - k])


def best_of_label(block: Block, anchor: dict, found: list, k: int) -> list:
    """The k first of ``found`` and the block's rows of the anchor's label, as (-score, no id, id, whether it is the anchor)."""
    first, last = block.of_label(anchor["label"])
    if first == last:
        return found
    least, most = block.bounds(anchor["vector"], first, last)
    bar = highest(least, k) if len(least) > k else None
    if len(found) == k:
        bar = max(-found[-1][0], bar if bar is not None else -found[-1][0])
    near = np.arange(first, last) if bar is None else first + np.flatnonzero(most >= bar)
    score = block.exact(anchor["vector"], near)
    if len(near) > 4 * k:
        keep = np.flatnonzero(score >= highest(score, k))
        keep = keep[np.lexsort((block.ids[near[keep]], block.none[near[keep]], -score[keep]))[:k]]
        # a copy of the anchor with its id and score may stand for the anchor, so none is lost by taking k
        near, score = near[keep], score[keep]
    own = [bool(block.ids[i] == anchor["vec_id"] and not block.none[i] and same_vector(block.values[i], anchor["vector"])) for i in near.tolist()]
    rows = zip((-score).tolist(), block.none[near].tolist(), block.ids[near].tolist(), (not x for x in own), strict=True)
    return nsmallest(k, [*found, *rows])


def same_vector(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two vectors are alike up to zeros at their ends."""
    n = min(len(a), len(b))
    return bool((a[:n] == b[:n]).all() and not a[n:].any() and not b[n:].any())


def window_of(positive: int, low_share: int, high_share: int) -> tuple[int, int]:
    """The least and largest whole scores between two shares, in hundredths, of a positive's score."""
    return -(-low_share * positive // 100), high_share * positive // 100


def best_in_windows(block: Block, anchor: dict, windows: list[tuple[int, int]], found: list[list], k: int) -> list[list]:
    """For each window the k first of ``found`` and the block's rows of other labels in it, as (-score, no id, id)."""
    useful = [w for w, (low, high) in enumerate(windows) if low <= high]
    if not useful:
        return found
    least, most = block.bounds(anchor["vector"], 0, block.n)
    bars = {w: max(windows[w][0], -found[w][-1][0] if len(found[w]) == k else windows[w][0]) for w in useful}
    some = (most >= min(bars.values())) & (least <= max(windows[w][1] for w in useful))
    first, last = block.of_label(anchor["label"])
    some[first:last] = False
    rows = np.flatnonzero(some)
    least, most = least[rows], most[rows]
    wanted = {}
    for w in useful:
        low, high = windows[w]
        near = (most >= bars[w]) & (least <= high)
        sure = least[(least >= low) & (most <= high)]
        if len(sure) >= k:
            near &= most >= highest(sure, k)
        wanted[w] = near
    any_of = np.flatnonzero(np.logical_or.reduce(list(wanted.values())))
    if not len(any_of):
        return found
    score = block.exact(anchor["vector"], rows[any_of])
    for w in useful:
        low, high = windows[w]
        at = np.flatnonzero((score >= low) & (score <= high) & wanted[w][any_of])
        if not len(at):
            continue
        if len(at) > 4 * k:
            at = at[score[at] >= highest(score[at], k)]
        own = rows[any_of[at]]
        order = np.lexsort((block.ids[own], block.none[own], -score[at]))[:k]
        new = zip((-score[at][order]).tolist(), block.none[own[order]].tolist(), block.ids[own[order]].tolist(), strict=True)
        found[w] = nsmallest(k, [*found[w], *new])
    return found


def dealt(rows: DataFrame, anchors: DataFrame, pack, packed: str, block_bytes: int) -> DataFrame:
    """Each block of rows beside each block of anchors; ``pack`` makes the latter, with the columns ``packed``."""
    spark = rows.sparkSession
    size = int(anchors.agg(F.coalesce(F.sum(F.octet_length("vector") + 32), F.lit(0))).first()[0])
    n_blocks, cores = rows.count(), spark.sparkContext.defaultParallelism
    n = max(1, -(-size // block_bytes))
    groups = max(1, min(n_blocks, cores), -(-n_blocks // BLOCKS_A_TASK))
    together = anchors.withColumn("own", F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")).groupBy("own").applyInArrow(pack, f"own int, {packed}")
    units = min(2 * n * groups, 1 << 16)
    key = ("own", "other")
    mine = together.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(units, *key)
    other = F.pmod(F.xxhash64("ids", "labels"), F.lit(groups)).cast("int")
    theirs = rows.withColumn("other", other).withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(units, *key)
    return theirs.join(mine, list(key))


def _anchor_block(fields: dict[str, pa.DataType]):
    def pack(rows: pa.Table) -> pa.Table:
        columns = {"own": pa.array([rows.column("own")[0].as_py()], pa.int32())}
        for name, kind in fields.items():
            columns[name] = pa.array([rows.column(name).to_pylist()], pa.list_(kind))
        return pa.table(columns)

    return pack


ANCHOR_FIELDS = {"number": pa.int64(), "vec_id": pa.int64(), "label": pa.int64(), "vector": pa.binary()}
ANCHOR_LISTS = "number array<long>, vec_id array<long>, label array<long>, vector array<binary>"


def _anchors(row: dict, extra: tuple[str, ...] = ()) -> list[dict]:
    names = ("number", "vec_id", "label", *extra)
    out = [dict(zip(names, x, strict=True)) for x in zip(*(row[n] for n in names), strict=True)]
    for anchor, vector in zip(out, row["vector"], strict=True):
        anchor["vector"] = np.frombuffer(vector, "<i4")
    return out


def _unit_rows(batches):
    """One row after the other; a batch may hold several, each as large as two blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def best_positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(number, positives): of each anchor its k best other rows of the same label as (score, vec_id), best first."""
    schema = "number long, score long, vec_id long, other boolean"

    def run(batches):
        key, own, found = None, [], []

        def done():
            flat = [(a["number"], -s, None if none else i, other) for a, best in zip(own, found, strict=True) for s, none, i, other in best]
            columns = list(zip(*flat, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["number", "score", "vec_id", "other"])

        for row in _unit_rows(batches):
            if row["own"] != key:
                if own:
                    yield done()
                key, own = row["own"], _anchors(row)
                found = [[] for _ in own]
            block = Block(row)
            found = [best_of_label(block, a, best, k + 1) for a, best in zip(own, found, strict=True)]
        if own:
            yield done()

    units = dealt(rows, anchors, _anchor_block(ANCHOR_FIELDS), ANCHOR_LISTS, block_bytes)
    first = W.partitionBy("number").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "other")
    each = units.mapInArrow(run, schema).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    few = each.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id", "other"))).alias("best"))  # k + 1 at most
    # the anchor itself goes, once
    itself = F.expr("coalesce(get(filter(best, x -> not x.other), 0).place, 0)").alias("itself")
    others = few.select("number", "best", itself).select("number", F.expr(f"slice(filter(best, x -> x.place <> itself), 1, {k})").alias("best"))
    return others.select("number", F.expr("transform(best, x -> named_struct('score', x.score, 'vec_id', x.vec_id))").alias("positives"))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_share: int = LOW_SHARE,
    high_share: int = HIGH_SHARE,
    scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id, embedding, label).

    For each anchor, a row for which ``is_anchor`` holds of its vec_id, and each of its first ``positives`` other rows of its label: the
    first ``negatives`` rows of other labels with a score between the two shares, in hundredths, of the positive's score.
    Scores are inner products of components times ``scale``, rounded down; higher ones come first, then smaller ids.
    """
    whole = scaled(vectors, scale)
    rows = written(blocks(whole, block_bytes), "approximations")
    chosen = whole.filter(is_anchor & F.col("vec_id").isNotNull())
    anchors = written(chosen.withColumn("number", F.monotonically_increasing_id()), "anchors")
    found = best_positives(rows, anchors, positives, block_bytes)
    paired = written(anchors.join(found, "number"), "positives")
    schema = "number long, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        key, own, windows, found = None, [], [], []

        def done():
            flat = []
            for a, of_anchor in zip(own, found, strict=True):
                for nth, (p, best) in enumerate(zip(a["positives"], of_anchor, strict=True)):
                    flat += [(a["number"], nth, a["vec_id"], p["vec_id"], p["score"], None if none else i, -s) for s, none, i in best]
            columns = list(zip(*flat, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "nth" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

        for row in _unit_rows(batches):
            if row["own"] != key:
                if own:
                    yield done()
                key, own = row["own"], _anchors(row, ("positives",))
                windows = [[window_of(p["score"], low_share, high_share) for p in a["positives"]] for a in own]
                found = [[[] for _ in w] for w in windows]
            block = Block(row)
            for a, w, best in zip(own, windows, found, strict=True):
                best_in_windows(block, a, w, best, negatives)
        if own:
            yield done()

    positive = pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])
    lists = f"{ANCHOR_LISTS}, positives array<array<struct<score: long, vec_id: long>>>"
    units = dealt(rows, paired, _anchor_block(ANCHOR_FIELDS | {"positives": pa.list_(positive)}), lists, block_bytes)
    first = W.partitionBy("number", "nth").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    ranked = units.mapInArrow(run, schema).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
