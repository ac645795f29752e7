"""Quality rules: every rule is evaluated once into a bit mask beside its measurements; policies read the mask.

``ledger`` measures each text and stores one bit for each rule that it fails.  A policy is a named, versioned
set of rules: ``verdict`` keeps a document whose mask and the policy's mask have no common bit, so a new
policy never reads a text again.  ``ablation`` counts, from the masks alone, how many documents each rule of a
policy rejects, rejects alone, and how many would be kept without it.  Only DataFrame functions are used, no row moves
to another partition except the counted masks, of which there are at most 2^rules.

Windows of three words are hashed by XXH64 and sorted with their places inside the document; of windows that share a hash
with a neighbour the words themselves are compared, in texts of any length.

Defined cases: a null or empty text has no words and measures zero; repeated rows are judged alike; an empty table
gives an empty ledger; further columns of the input are left out, so their names cannot clash; very long texts are measured
whole, by arrays inside one row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_letterless", "n_ellipses", "n_bullets",
)

#: Rule name to the condition under which a document fails; the order gives the bits and only grows.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
    "shouting": "2 * n_exclaims > n_words",
    "letterless_words": "2 * n_letterless > n_words",
    "ellipses": "10 * n_ellipses > 3 * n_lines",
    "bullets": "10 * n_bullets > 9 * n_lines",
}
#: Policy name and version to its rules.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_words"),
    ("strict", 1): tuple(RULES)[:6],
    ("strict", 2): tuple(RULES),
}


def mask_of(rules: Iterable[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    one = docs.select(docs["doc_id"].alias("doc_id"), text.alias("t"))
    split = one.select(
        "doc_id",
        "t",
        F.array_remove(F.split("t", SPACES), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    windows = "sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)))"
    count = lambda column, pattern: F.size(F.filter(column, lambda x: x.rlike(pattern))).cast("long")
    sorted_ = split.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclaims"),
        count("w", r"^[^\p{L}]+\z").alias("n_letterless"),
        count("l", r"(\.\.\.|…)[\x20\x09-\x0D]*\z").alias("n_ellipses"),
        count("l", r"^[\x20\x09-\x0D]*[-*•]").alias("n_bullets"),
        F.expr(f"case when size(w) > 2 then {windows} end").alias("s"),
    )
    near = F.expr("filter(s, (x, k) -> x.h = get(s, k - 1).h or x.h = get(s, k + 1).h)")
    spelled = sorted_.withColumn("s", near).withColumn("s", F.expr("transform(s, x -> struct(array_join(slice(w, x.i + 1, 3), ' ') as v, x.i as i))"))
    proved = spelled.withColumn("s", F.sort_array("s"))
    same = "transform(filter(s, (x, k) -> x.v = get(s, k - 1).v or x.v = get(s, k + 1).v), x -> x.i)"
    places = proved.withColumn("at", F.sort_array(F.coalesce(F.expr(same), F.expr("cast(array() as array<int>)"))))
    covered = F.expr("aggregate(transform(at, (x, k) -> least(3, coalesce(get(at, k + 1), x + 3) - x)), 0L, (a, x) -> a + x)")
    return places.withColumn("n_repeat_words", covered).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i is set where the i-th rule fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, cond in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return _measured(docs).withColumn("failed", total)


def fails(rules: Iterable[str], failed: str = "failed") -> Column:
    """Whether a document fails any of the rules."""
    return F.col(failed).bitwiseAND(F.lit(mask_of(rules)).cast("long")) != 0


def verdict(book: DataFrame, name: str, version: int) -> DataFrame:
    """The ledger with ``kept`` by a policy."""
    return book.withColumn("kept", ~fails(POLICIES[name, version]))


def sole_rule(name: str, version: int, failed: str = "failed") -> Column:
    """The rule of a policy that alone rejects a document; null where none or several do."""
    rules = POLICIES[name, version]
    used = F.col(failed).bitwiseAND(F.lit(mask_of(rules)).cast("long"))
    return F.coalesce(*[F.when(used == mask_of([r]), F.lit(r)) for r in rules])


def ablation(book: DataFrame, name: str, version: int) -> DataFrame:
    """(rule, rejected, rejected_alone, kept_without) for each rule of a policy."""
    rules = POLICIES[name, version]
    used = F.lit(mask_of(rules)).cast("long")
    masks = book.groupBy(F.col("failed").bitwiseAND(used).alias("m")).count()
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in rules]))
    rows = masks.withColumn("r", each).select("m", "count", "r.rule", "r.bit")
    amount = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        amount(hit).alias("rejected"),
        amount(F.col("m") == F.col("bit")).alias("rejected_alone"),
        amount((F.col("m") == 0) | (F.col("m") == F.col("bit"))).alias("kept_without"),
    )
