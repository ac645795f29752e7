"""Work history as rows: blocks of an experience section, and entries without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import history as h
from ..functions import text as t
from ..functions.resume import date_ranges
from ..functions.sections import plain_line


def block_numbers(rows: DataFrame, key: str) -> DataFrame:
    """``block`` of rows (key, n, line, dated, org, heading) of a section's lines.

    A block begins after an empty line, at a heading before a dated line, and at a dated line or an ``Organization:`` line where the
    block before has a date.  Windows run over one section's lines.
    """
    order = W.partitionBy(key).orderBy("n")
    following = F.first(F.when(F.col("line") != "", F.col("dated")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    seen = rows.withColumn("opens", F.col("heading") & F.coalesce(following, F.lit(False)))
    event = F.when(F.col("dated"), "dated").when((F.col("line") == "") | F.col("org") | F.col("opens"), "reset")
    before = F.coalesce(F.last(event, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(""))
    starts = (F.col("line") == "") | (~F.col("dated") & F.col("opens")) | ((F.col("dated") | F.col("org")) & (before == "dated"))
    return seen.withColumn("starts", starts).withColumn("block", F.sum(F.col("starts").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def blocks(sections: DataFrame, key: str, content: str, last_year: int) -> DataFrame:
    """(key, block, lines) of the parts of a section that hold a date; a heading is a role in a line of twelve words."""
    lines = F.transform(F.split(t.line_breaks(F.col(content)), "\n"), lambda x: F.regexp_replace(plain_line(x), r"^[ |\-]+|[ |\-]+\z", ""))
    rows = sections.select(key, F.posexplode(lines).alias("n", "line"))
    role = (F.size(F.split("line", " ")) <= 12) & ~F.col("line").endswith(".") & F.col("line").rlike(rf"(?i)\b(?:{h.ROLES})\b")
    seen = rows.select(
        key, "n", "line",
        (F.size(date_ranges(F.col("line"), last_year)) > 0).alias("dated"),
        F.col("line").rlike(r"(?i)^organization\s*:\s*.+\z").alias("org"),
        ((F.col("line") != "") & role).alias("heading"),
    )
    parts = block_numbers(seen, key).filter("line <> ''").groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"), F.bool_or("dated").alias("dated"))
    return parts.filter("dated").select(key, "block", F.transform("l", lambda s: s["line"]).alias("lines"))


def distinct_entries(entries: DataFrame, key: str, place: str) -> DataFrame:
    """Entries without those of the same role and dates, then of the same company and dates.

    Of the first kind the one that is current and has the longer company stays, of the second the one with more words in
    its role; ties go to the earlier place.
    """
    end = F.coalesce("end", F.lit("2030-01-01").cast("date"))
    first = W.partitionBy(key, "role", "start", end).orderBy(F.col("is_current").desc(), F.length("company").desc(), place)
    kept = entries.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    words = F.size(F.split(F.coalesce("role", F.lit("")), " "))
    second = W.partitionBy(key, h.company_key(F.col("company")), "start", end).orderBy(words.desc(), place)
    return kept.withColumn("_r", F.row_number().over(second)).filter("_r = 1").drop("_r")


def new_uploads(batch: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a batch whose keys are not stored; of equal keys the first."""
    fresh = batch.join(stored, keys, "left_anti")
    return fresh.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")
