"""Training folds and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .texts import id_and_text

MAX_LABELLED = 20_000


def fold(column: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled ids outside the held-out fold, the same on every run.

    The ids are those with the smallest hashes.  A null label or id is no label; of differing labels of
    one id the largest counts.  The sample is written, so that several steps read it and not the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    some = (
        known.filter("doc_id is not null and y is not null")
        .filter(~held_out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return written(id_and_text(docs).join(F.broadcast(some), "doc_id"), "sample")  # bounded by max_rows


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + penalty * w
        curve = (x.T * (p * (1 - p))) @ x / len(y) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
