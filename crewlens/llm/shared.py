"""Tables in the cluster's shared folder, numbers of tasks that follow the corpus, and joins on keys that may be hot."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_BYTES = 32 << 20
HOT_ROWS = 1_000
MOST_HOT = 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="crewlens-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(frame: DataFrame, tag: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts the lineage and survives lost executors."""
    return written_at(frame, tag)[0]


def written_at(frame: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, and where, for ``discard``."""
    path = f"{shared_folder(frame.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that a later one has replaced."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``written`` whose tables are deleted at the end; what is returned from inside must not read them any more."""
    paths: list[str] = []

    def put(frame: DataFrame, tag: str) -> DataFrame:
        table, path = written_at(frame, tag)
        paths.append(path)
        return table

    yield put
    for path in paths:
        discard(spark, path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of each action at its end, not at some later collection of garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are over: it does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text, over all rows."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def task_count(spark: SparkSession, size: int, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for so many bytes: about ``task_bytes`` each, and no fewer than the cluster has cores."""
    return max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """``rows`` and ``table`` joined on ``key``, of which a third of all rows may have one value.

    ``table`` has one row a key, and in ``n`` how many of the ``total`` rows have it; ``n`` is left out.  Keys that
    more than ``total`` / ``MOST_HOT`` rows have (and more than ``HOT_ROWS``) are fewer than ``MOST_HOT``: these few are broadcast,
    and their rows stay where they are.  ``rows`` is read twice and is best a written table.
    """
    limit = max(HOT_ROWS, -(-total // MOST_HOT))
    hot = F.broadcast(table.filter(F.col(n) > limit).drop(n))
    cold = rows.join(hot.select(*key), key, "left_anti").join(table.filter(F.col(n) <= limit).drop(n), key)
    return cold.unionByName(rows.join(hot, key))
