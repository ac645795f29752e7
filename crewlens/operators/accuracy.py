"""How well fields were extracted: shares, errors, precision and recall over rows with what was found and what is true.

Defined cases: a field without cases has a null share; an empty list that is found where none is meant counts as right (precision and recall 1); where one
of both is empty, the measure that divides by it is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READY = 0.8


def overlap(found: Column, true: Column) -> Column:
    """(precision, recall) of a list against the true one, without regard to case and repeats."""
    low = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    a, b = low(found), low(true)
    both, none = F.size(F.array_intersect(a, b)), (F.size(a) == 0) & (F.size(b) == 0)
    share = lambda c: F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(both, F.size(c)), F.lit(0.0)))
    return F.struct(share(a).alias("precision"), share(b).alias("recall"))


def benchmark(rows: DataFrame, texts: Sequence[str], numbers: Sequence[str], lists: Sequence[str], places: int = 4) -> DataFrame:
    """(field, measure, value) of fields ``x`` against ``true_x``.

    Texts have ``accuracy``; numbers ``accuracy`` and ``mae``, the mean absolute error over rows with both; lists ``precision`` and ``recall`` as means
    over rows, and ``f1`` of these means.  All come from one pass: sums are taken before the exchange, and one row is turned into many.
    """
    same = lambda a, b: F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), a.isNull() & b.isNull()).cast("double")
    exact = lambda a, b: F.coalesce(a == b, a.isNull() & b.isNull()).cast("double")
    c = lambda x: (F.col(x), F.col(f"true_{x}"))
    parts = rows.select(
        *[same(*c(x)).alias(f"{x}.accuracy") for x in texts],
        *[exact(*c(x)).alias(f"{x}.accuracy") for x in numbers],
        *[F.abs(F.col(x) - F.col(f"true_{x}")).cast("double").alias(f"{x}.mae") for x in numbers],
        *[overlap(*c(x)).alias(f"{x}.lists") for x in lists],
    )
    single = [f"{x}.accuracy" for x in (*texts, *numbers)] + [f"{x}.mae" for x in numbers]
    means = [F.avg(F.col(f"`{n}`")).alias(n) for n in single]
    means += [F.avg(F.col(f"`{x}.lists`")[m]).alias(f"{x}.{m}") for x in lists for m in ("precision", "recall")]
    one = parts.agg(*means)
    value = lambda n: F.col(f"`{n}`")
    entry = lambda n, v: F.struct(F.lit(n.split(".")[0]).alias("field"), F.lit(n.split(".")[1]).alias("measure"), F.round(v, places).alias("value"))
    each = [entry(n, value(n)) for n in single]
    for x in lists:
        p, r = value(f"{x}.precision"), value(f"{x}.recall")
        each += [entry(f"{x}.precision", p), entry(f"{x}.recall", r), entry(f"{x}.f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.when(p.isNotNull(), 0.0)))]
    return one.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def compared(before: DataFrame, after: DataFrame, places: int = 4) -> DataFrame:
    """(field, measure, before, after, gain) of two benchmarks."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), ["field", "measure"])
    return both.withColumn("gain", F.round(F.col("after") - F.col("before"), places))


def readiness(report: DataFrame, least: float = READY) -> DataFrame:
    """The report with ``ready``: whether a measure reaches ``least``; errors count the other way round, at most 1 - ``least``."""
    good = F.when(F.col("measure") == "mae", F.col("value") <= 1 - least).otherwise(F.col("value") >= least)
    return report.withColumn("ready", F.coalesce(good, F.lit(False)))


def audited(rows: DataFrame, numbers: Sequence[str], flags: Sequence[str], places: int = 4) -> DataFrame:
    """(item, n, mean, least, most) of measured numbers, and of flags how many rows have them and their share."""
    aggs = [F.count(F.lit(1)).alias("all")]
    for x in numbers:
        aggs += [F.count(x).alias(f"{x}.n"), F.avg(x).alias(f"{x}.mean"), F.min(x).alias(f"{x}.least"), F.max(x).alias(f"{x}.most")]
    for x in flags:
        aggs += [F.count_if(F.col(x)).alias(f"{x}.n"), F.avg(F.coalesce(F.col(x), F.lit(False)).cast("double")).alias(f"{x}.mean")]
    one = rows.agg(*aggs)
    number = lambda x, m: F.round(F.col(f"`{x}.{m}`").cast("double"), places)
    none = F.lit(None).cast("double")
    each = [F.struct(F.lit(x).alias("item"), F.col(f"`{x}.n`").alias("n"), number(x, "mean").alias("mean"), number(x, "least").alias("least"), number(x, "most").alias("most")) for x in numbers]
    each += [F.struct(F.lit(x).alias("item"), F.col(f"`{x}.n`").alias("n"), number(x, "mean").alias("mean"), none.alias("least"), none.alias("most")) for x in flags]
    return one.select(F.explode(F.array(*each)).alias("e")).select("e.*")
