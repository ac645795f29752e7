"""Geometry of pages over rows of words: words to lines, lines to segments, pages to columns, and the text in reading order.

A line begins at a word that lies more than ``tolerance`` below the first word of the line before it; a segment of a line begins after a gap of
more than ``gap``.  Lines are found over the distinct heights of a page, in one fold a page.  Words are sent
once, by their page; all later windows and groupings have the page's key first and stay where the words are.

Defined cases: words without a place or with blank text are left out; a page without words has no lines; words of equal place stand in the
order of their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tolerances in points, lines that each column must have, and where on a page the columns may part.
LINE_TOLERANCE, SEGMENT_GAP, COLUMN_GAP, COLUMN_LINES = 3.0, 35.0, 60.0, 8
SPLIT_FROM, SPLIT_TO = 0.18, 0.55


def words_to_lines(words: DataFrame, page: list[str], tolerance: float = LINE_TOLERANCE, gap: float = SEGMENT_GAP) -> DataFrame:
    """(page, line, segment, text, x0, x1, top) of words (page, n, text, x0, x1, top)."""
    there = words.filter(F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("top").isNotNull() & (F.trim("text") != ""))
    word = F.struct("x0", "top", "n", F.trim("text").alias("text"), "x1")
    whole = there.groupBy(*page).agg(F.collect_list(word).alias("w"))  # words of one page
    tops = whole.withColumn("tops", F.array_sort(F.array_distinct(F.transform("w", lambda x: x["top"]))))
    begin = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(s, top):
        new = s["first"].isNull() | (top - s["first"] > tolerance)
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(F.when(new, top).otherwise(s["first"]).alias("first"), line.alias("line"), F.concat(s["lines"], F.array(line)).alias("lines"))

    numbered = tops.withColumn("lines", F.aggregate("tops", begin, step, lambda s: s["lines"]))
    line = F.get("lines", (F.array_position("tops", F.col("w.top")) - 1).cast("int"))
    placed = numbered.select(*page, "tops", "lines", F.explode("w").alias("w")).select(*page, line.alias("line"), "w.*")
    order = W.partitionBy(*page, "line").orderBy("x0", "top", "n")
    fresh = F.coalesce(F.col("x0") - F.lag("x1").over(order) > gap, F.lit(False)).cast("int")
    parts = placed.withColumn("fresh", fresh).withColumn("segment", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("x0", "top", "n", F.col("text").alias("t"))))  # words of one segment
    one = parts.groupBy(*page, "line", "segment").agg(ordered.alias("w"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"))
    return one.select(*page, "line", F.col("segment").cast("int").alias("segment"), F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("text"), "x0", "x1", "top")


def column_splits(lines: DataFrame, page: list[str], width: float, gap: float = COLUMN_GAP, least: int = COLUMN_LINES) -> DataFrame:
    """(page, split): where pages part into two columns, in the middle of the widest gap between places at which lines begin.

    Each side has ``least`` lines, the left ones are shorter on average, and the place lies between two shares of the page's width.
    """
    starts = lines.groupBy(*page, F.round("x0", 1).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("w"))
    order, whole = W.partitionBy(*page).orderBy("x"), W.partitionBy(*page)
    left = order.rowsBetween(W.unboundedPreceding, 0)
    sides = starts.select(
        *page, "x", F.lead("x").over(order).alias("next"), F.sum("n").over(left).alias("n0"), F.sum("w").over(left).alias("w0"), F.sum("n").over(whole).alias("n1"), F.sum("w").over(whole).alias("w1")
    ).withColumns({"n1": F.col("n1") - F.col("n0"), "w1": F.col("w1") - F.col("w0"), "gap": F.col("next") - F.col("x"), "split": (F.col("x") + F.col("next")) / 2})
    fits = sides.filter((F.col("gap") >= gap) & (F.col("n0") >= least) & (F.col("n1") >= least) & (F.col("w0") * F.col("n1") < F.col("w1") * F.col("n0")))
    fits = fits.filter((F.col("split") > width * SPLIT_FROM) & (F.col("split") < width * SPLIT_TO))
    return fits.groupBy(*page).agg(F.max(F.struct(F.col("gap"), (-F.col("x")).alias("x"), "split"))["split"].alias("split"))


def with_splits(lines: DataFrame, page: list[str], width: float, gap: float = COLUMN_GAP, least: int = COLUMN_LINES) -> DataFrame:
    """Lines with the ``split`` of their page as ``column_splits`` has it; windows over the lines of a page, so that they are made and sent once."""
    there = lines.withColumn("x", F.round("x0", 1))
    order, whole = W.partitionBy(*page).orderBy("x"), W.partitionBy(*page)
    left = order.rangeBetween(W.unboundedPreceding, W.currentRow)
    wide = F.col("x1") - F.col("x0")
    sides = {"next": F.lead("x").over(order), "n0": F.count(F.lit(1)).over(left), "w0": F.sum(wide).over(left), "n1": F.count(F.lit(1)).over(whole), "w1": F.sum(wide).over(whole)}
    told = there.withColumns(sides).withColumns({"n1": F.col("n1") - F.col("n0"), "w1": F.col("w1") - F.col("w0"), "gap": F.col("next") - F.col("x"), "split": (F.col("x") + F.col("next")) / 2})
    # of lines that begin at the same place the last one has the gap
    fits = (F.col("gap") >= gap) & (F.col("n0") >= least) & (F.col("n1") >= least) & (F.col("w0") * F.col("n1") < F.col("w1") * F.col("n0"))
    fits = fits & (F.col("split") > width * SPLIT_FROM) & (F.col("split") < width * SPLIT_TO)
    best = F.max(F.when(fits, F.struct(F.col("gap"), (-F.col("x")).alias("x"), "split"))).over(whole)
    return told.withColumn("best", best).select(*lines.columns, F.col("best.split").alias("split"))


def reading_order(lines: DataFrame, splits: DataFrame | None, page: list[str]) -> DataFrame:
    """Lines with ``column`` (0 or 1) and ``place``: the left column from top to bottom, then the right one.

    Without ``splits`` the lines have them themselves.
    """
    both = (lines if splits is None else lines.join(splits, page, "left")).withColumn("column", F.coalesce((F.col("x0") >= F.col("split")).cast("int"), F.lit(0)))
    order = W.partitionBy(*page).orderBy("column", "line", "segment")
    return both.withColumn("place", F.row_number().over(order) - 1).drop("split")
