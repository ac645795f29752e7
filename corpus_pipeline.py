"""A training corpus from ``documents`` in five stages; each calls one operator on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.llm import quality
from crewlens.llm.decontaminate import clean
from crewlens.llm.labelled import fold
from crewlens.llm.lines import without_repeated_lines
from crewlens.llm.packing import packed
from crewlens.llm.shared import brief_shuffles, discard, written_at
from crewlens.llm.similar import one_of_each_similar


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns outside the held-out fold."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) == 2)
    return quality.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with lines that an earlier document has taken out of their texts."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-duplicates: those whose five-word shingles are 0.8 similar to a document that stays go."""
    return one_of_each_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return clean(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the fingerprints cannot be expressed in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written to the shared folder, read by the next, and deleted after it."""
    docs, before = _table(spark, sf_dir, "documents"), None
    with brief_shuffles(spark):
        for name, stage in STAGES[:-1]:
            docs, path = written_at(stage(spark, docs, sf_dir), name)
            if before:
                discard(spark, before)
            before = path
    return STAGES[-1][1](spark, docs, sf_dir)
