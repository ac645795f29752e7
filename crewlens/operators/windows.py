"""Latest and next rows by key, precedence, gaps and islands, dense outputs, funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import STATUS_RANKS


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; Spark prunes to one row a key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_interview(interviews: DataFrame) -> DataFrame:
    """Each candidate's interview with the latest schedule, where no schedule comes before any."""
    return first_per_key(
        interviews, ["candidate_id"], [F.col("scheduled_at").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.col("id").desc()]
    )


def next_slot(slots: DataFrame, key: str, today: str) -> DataFrame:
    """Each key's first slot from a day on; slots without a time come last on their day."""
    ahead = slots.filter(F.col("slot_date") >= F.lit(today).cast("date"))
    return first_per_key(ahead, [key], [F.col("slot_date"), F.col("slot_time").asc_nulls_last(), F.col("id")])


def last_slot(slots: DataFrame, key: str) -> DataFrame:
    order = [F.col("slot_date").desc_nulls_first(), F.col("slot_time").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.col("id")]
    return first_per_key(slots, [key], order)


def by_precedence(interviews: DataFrame, status: Column) -> DataFrame:
    """Each candidate's interview with the highest (schedule, creation, rank of status); the lowest id of equal ones."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_RANKS.items() for x in kv])[status], F.lit(1))
    planned = F.coalesce("scheduled_at", "created_at")
    made = F.coalesce("created_at", "scheduled_at")
    order = [planned.desc_nulls_last(), made.desc_nulls_last(), rank.desc(), F.col("id")]
    return first_per_key(interviews, ["candidate_id"], order)


def merge_intervals(df: DataFrame, key: str, start: str, end: str, gap_days: int = 1) -> DataFrame:
    """Islands of date intervals that overlap or follow within ``gap_days``: (key, start, end, pieces)."""
    order = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > F.date_add(reach, gap_days)), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumn("_new", fresh).withColumn("_island", island)
    return marked.groupBy(key, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("pieces")
    ).drop("_island")


def dense(dimension: Sequence[str], counts: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each member of a small fixed dimension, zero where nothing was counted."""
    spark = counts.sparkSession
    dim = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in dimension])).alias("ordinal", key))
    return F.broadcast(dim).join(counts, key, "left").select("ordinal", key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def funnel(wide: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """From one row of counts: (ordinal, stage, count, conversion, dropoff) against the step before."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("stage"), F.col(c).alias("count")) for i, (n, c) in enumerate(steps)]))
    tall = wide.select(rows.alias("r")).select("r.*")
    before = F.lag("count").over(W.partitionBy(F.lit(0)).orderBy("ordinal"))  # as many rows as steps
    none = before.isNull() | (before == 0)
    conversion = F.when(none, F.when(F.col("count") > 0, 100.0).otherwise(0.0)).otherwise(F.round(F.try_divide(F.col("count") * 100.0, before), 1))
    with_rate = tall.withColumn("conversion", conversion).withColumn("_none", none)
    drop = F.when(F.col("_none"), 0.0).otherwise(F.greatest(F.lit(0.0), F.round(100 - F.col("conversion"), 1)))
    return with_rate.withColumn("dropoff", drop).drop("_none")
