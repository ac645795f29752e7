"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality as good
from . import toxicity as tox
from .decontaminate import contamination
from .labelled import fold
from .language_model import lm_scores
from .lines import line_bitmaps
from .negatives import hard_negatives
from .packing import packed
from .resampling import resampled
from .rules import POLICIES, ablation, fails, ledger, sole_rule, verdict
from .shared import written
from .simhash import near_duplicates
from .substrings import substring_dedup
from .token_files import token_counts
from .token_store import token_ids

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under the policy ("strict", 2); rejects of one rule alone carry what the policy keeps without it."""
    policy = ("strict", 2)
    stored = written(ledger(table(spark, sf_dir, "documents")), "ledger")
    book = verdict(stored, *policy).withColumn("sole_rule", sole_rule(*policy))
    without = ablation(stored, *policy).select(F.col("rule").alias("sole_rule"), "kept_without")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = fails(POLICIES["base", 1]).alias("base_failed")
    joined = book.join(F.broadcast(without), "sole_rule", "left")  # one row a rule
    return joined.select("doc_id", *counts, base, "kept", F.col("failed").alias("failed_rules"), "sole_rule", "kept_without")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    scored = tox.toxicity(docs, tox.fit(docs, table(spark, sf_dir, "labels"), held_out))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join("items", ",").alias("items"), "similarity")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run lengths of ``keep_bitmap`` are joined by commas."""
    return line_bitmaps(table(spark, sf_dir, "documents")).withColumn("keep_bitmap", F.array_join("keep_bitmap", ","))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    scored = good.quality(docs, good.fit(docs, table(spark, sf_dir, "labels"), held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on first; anchors are the ids divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_simhash_near_dedup, op3_toxicity, op4_token_counts, op5_lm_scoring, op6_substring_dedup, op7_benchmark_decontamination, op8_line_dedup, op9_packing, op10_quality_classifier, op11_hard_negatives, op12_token_ids, op13_importance_resampling)}


ORACLES = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3""",
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
g AS (SELECT doc_id, i, w[i:i + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM g) WHERE c > 1),
x AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
         CAST(len(list_filter(w, lambda v: regexp_matches(v, '^[^\p{L}]+\z'))) AS BIGINT) AS n_letterless,
         CAST(len(list_filter(l, lambda v: regexp_matches(v, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS BIGINT) AS n_ellipses,
         CAST(len(list_filter(l, lambda v: regexp_matches(v, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullets
  FROM s LEFT JOIN x ON x.doc_id = s.doc_id),
f AS (
  SELECT *, CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT)
         + 4 * CAST(10 * n_symbols > n_words AS INT) + 8 * CAST(2 * n_dup_lines > n_lines AS INT)
         + 16 * CAST(word_chars > 20 * n_words OR word_chars < 2 * n_words AS INT)
         + 32 * CAST(2 * n_exclaims > n_words AS INT) + 64 * CAST(2 * n_letterless > n_words AS INT)
         + 128 * CAST(10 * n_ellipses > 3 * n_lines AS INT) + 256 * CAST(10 * n_bullets > 9 * n_lines AS INT) AS failed
  FROM m),
o(bit, sole_rule) AS (
  VALUES (1, 'few_words'), (2, 'repeated_words'), (4, 'symbols'), (8, 'repeated_lines'), (16, 'word_length'), (32, 'shouting'),
         (64, 'letterless_words'), (128, 'ellipses'), (256, 'bullets')),
k AS (SELECT bit, sole_rule, CAST((SELECT count(*) FROM f WHERE failed = 0 OR failed = bit) AS BIGINT) AS kept_without FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       failed = 0 AS kept, CAST(failed AS BIGINT) AS failed_rules, sole_rule, kept_without
FROM f LEFT JOIN k ON f.failed = k.bit
""",
    "op6_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM g) WHERE doc_id > f),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM r),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
k AS (
  SELECT p.doc_id, count(x.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE x.p IS NULL) AS t
  FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""",
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS p, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
m AS (SELECT *, CASE WHEN length(key) >= 10 THEN min(doc_id) OVER (PARTITION BY key) ELSE doc_id END AS f FROM k),
i AS (SELECT doc_id, p, doc_id = f AS kept, p - row_number() OVER (PARTITION BY doc_id, doc_id = f ORDER BY p) AS island FROM m),
r AS (SELECT doc_id, kept, min(p) AS a, count(*) AS n FROM i GROUP BY doc_id, kept, island),
b AS (
  SELECT doc_id, CASE WHEN arg_min(kept, a) THEN '' ELSE '0,' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY a) AS keep_bitmap
  FROM r GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id > f) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE doc_id = f), '')) AS kept_sha256
  FROM m GROUP BY doc_id)
SELECT s.*, keep_bitmap FROM s JOIN b ON b.doc_id = s.doc_id
""",
}
