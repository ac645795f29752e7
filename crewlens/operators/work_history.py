"""Work history from free text: entries of blocks, entries of single lines, and the total that is drawn from both.

Lines are rows, numbered within their résumé.  Lines that belong together (a block, or the lines around a date) form a group, a list in one
row; the first reading that holds is taken by a fold over the lines in order of trust, and those after it are not tried.  All windows
and groupings of a layer have the résumé's key first, so a layer costs one exchange by that key, and a group is as long as a section at most.

Defined cases: sections that are null or empty, and groups without a valid range of dates, give no entries; a résumé without entries has no
row in the lists of entries and a row with zeros in the total; equal entries are one; ties go to the earlier line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import history as h
from ..functions import text as t
from ..functions import worklines as wl
from ..functions.arrays import let
from ..functions.dates import duration_text, months_inclusive
from ..functions.scoring import use_second_layer
from .experience import block_numbers, distinct_entries

MOST_MONTHS = 45 * 12
HEADLINES, NEAR, LABELS = 3, 2, 4


def section_lines(sections: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n, line): rewritten lines of sections, empty ones too."""
    lines = F.transform(F.split(t.line_breaks(F.col(content)), "\n"), wl.work_line)
    return sections.select(key, F.posexplode(lines).alias("n", "line"))


def blocks(sections: DataFrame, key: str, content: str, today: Column) -> DataFrame:
    """(key, part, lines): the lines (line, spans) of blocks that hold a range of dates."""
    lines = section_lines(sections, key, content).withColumn("spans", wl.spans(F.col("line"), today))
    heading = (F.size(F.split("line", " ")) <= 12) & ~F.col("line").endswith(".") & F.col("line").rlike(wl.HAS_ROLE)
    org = F.col("line").rlike(r"(?i)^organization\s*:\s*.+\z")
    seen = lines.select("*", (F.size("spans") > 0).alias("dated"), org.alias("org"), ((F.col("line") != "") & heading).alias("heading"))
    numbered = block_numbers(seen, key).filter("line <> ''")
    lines = F.array_sort(F.collect_list(F.struct("n", "line", "spans")))
    dated = numbered.groupBy(key, F.col("block").alias("part")).agg(lines.alias("lines"), F.max("dated").alias("_any")).filter("_any")
    return dated.select(key, "part", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["spans"].alias("spans"))).alias("lines"))


def surroundings(sections: DataFrame, key: str, content: str, today: Column) -> DataFrame:
    """(key, part, lines): lines (line, spans) around each line that has a date, by itself or with the next line.

    They are the line before, the line and the two after, but for headings of other sections.  Only lines that speak of a role or a
    company are tried with the next.
    """
    line = F.col("line")
    full = section_lines(sections, key, content).filter("line <> ''")
    full = full.withColumn("alone", wl.wider_spans(line, today))
    order = W.partitionBy(key).orderBy("n")
    at = lambda k: F.lead("line", k).over(order)
    own = full.select(key, "n", "line", "alone", F.lag("line").over(order).alias("before"), at(1).alias("after"), at(2).alias("later"))
    speaks = line.rlike(wl.HAS_ROLE) | line.rlike(wl.HAS_COMPANY) | line.rlike(r"(?i) \| | at | in |^(?:organization|designation)\s*:\s*.")
    digits = line.rlike(r"\d") | F.col("after").rlike(r"\d")
    paired = F.when((F.size("alone") == 0) & digits & speaks, wl.wider_spans(F.concat_ws(" ", "line", "after"), today))
    # a generator, unlike a filter, does not work the spans out twice
    some = F.explode(F.filter(F.array(F.coalesce(paired, "alone")), lambda s: F.size(s) > 0)).alias("spans")
    own = own.select("*", some)
    around = F.filter(F.array("before", "line", "after", "later"), lambda x: x.isNotNull() & ~x.rlike(rf"(?i)^(?:{wl.OTHER_SECTIONS})\z"))
    of_group = F.transform(around, lambda x: F.struct(x.alias("line"), F.col("spans").alias("spans")))
    return own.select(key, F.col("n").alias("part"), of_group.alias("lines")).filter(F.size("lines") > 0)


def _first_told(xs: Column, reading: Callable[[Column], Column]) -> Column:
    """The first reading of a list that says something; those after it are not worked out."""
    return F.aggregate(xs, F.lit(None).cast("string"), lambda found, x: F.coalesce(found, reading(x)))


def read_groups(groups: DataFrame, key: str) -> DataFrame:
    """(key, part, company, role, lines, bullets): what each group of lines says; ``lines`` are (place, line, spans, bare)."""
    first = lambda n: F.slice("lines", F.lit(1), F.lit(n))
    with_bare = groups.withColumn("bares", F.transform(first(HEADLINES), lambda x: wl.without_dates(x["line"])))
    dated = F.array_position(F.transform("lines", lambda x: wl.has_range(x["line"])), F.lit(True)).cast("int")
    told = with_bare.select("*", _first_told(F.col("bares"), lambda x: F.nullif(wl.title_of(x), F.lit(""))).alias("title"), F.coalesce(F.nullif(dated, F.lit(0)), F.lit(1)).alias("date_place"))
    line_at = lambda off: F.get("lines", F.col("date_place") - 1 + off)["line"]
    beside = lambda off: let(line_at(off), lambda x: F.when(~x.rlike(rf"(?i)^(?:{wl.SECTION_NAMES})\z"), x))
    # the line of the date first, then those before it, then those after it
    offs = F.array(*[F.lit(off) for off in (0, *range(-NEAR, 0), *range(1, NEAR + 1))])
    near = F.transform(offs, lambda off: F.when(off == 0, wl.without_dates(line_at(0))).otherwise(beside(off)))
    near = F.filter(F.transform(near, lambda x: F.nullif(F.replace(x, F.lit("?"), F.lit("|")), F.lit(""))), lambda x: x.isNotNull())
    label = lambda x, name: F.nullif(F.trim(F.regexp_extract(x["line"], rf"(?i)^{name}\s*:\s*(.+)$", 1)), F.lit(""))
    title = F.col("title")
    company = F.coalesce(
        _first_told(first(LABELS), lambda x: wl.clean_company(label(x, "organization"))),
        _first_told(F.col("bares"), lambda x: let(F.when(x != "", wl.heading_company(x, title)), lambda c: F.when(wl.is_company(c), c))),
        _first_told(F.col("near"), lambda x: wl.near_company(x, title)),
    )
    with_company = told.withColumn("near", near).withColumn("company", company)
    role = F.coalesce(
        _first_told(first(LABELS), lambda x: let(label(x, "designation"), lambda c: F.when(~wl.is_skill(c), c))),
        _first_told(F.col("near"), lambda x: wl.near_role(x, F.col("company"))),
    )
    bare_line = lambda i: F.nullif(F.get("bares", i), F.lit(""))
    lines = F.transform("lines", lambda x, i: F.struct((i + 1).alias("place"), x["line"].alias("line"), x["spans"].alias("spans"), bare_line(i).alias("bare")))
    bullets = F.exists(first(2), lambda x: x["line"].rlike(wl.BULLET))
    # through a generator no filter of the callers moves below, where it would work out company and role once more
    read = F.struct("company", role.alias("role"), lines.alias("lines"), bullets.alias("bullets"))
    return with_company.select(key, "part", F.explode(F.array(read)).alias("read")).select(key, "part", "read.*")


def _entry(read: DataFrame, key: str, part: str) -> DataFrame:
    """Months and sureness of entries; ``start`` and ``end`` become the first and last day of their months."""
    full = read.withColumn("start", F.trunc("start", "month").cast("date")).withColumn("end", F.last_day("end"))
    full = full.withColumn("months", months_inclusive(F.col("start"), F.col("end")))
    sure = wl.sureness(F.col("company"), F.col("role"), F.col("months"))
    return full.select(key, part, "company", "role", "start", "end", "is_current", "months", sure.alias("confidence"), "description")


def _described(pattern: str) -> Column:
    some = F.filter("lines", lambda x: ~x["line"].rlike(pattern) & ~x["line"].eqNullSafe(F.col("role")) & ~x["line"].eqNullSafe(F.col("company")))
    return F.left(F.array_join(F.transform(some, lambda x: x["line"]), " "), F.lit(600))


def block_entries(sections: DataFrame, key: str, content: str, as_of: str) -> DataFrame:
    """One entry for each block with a range of dates and a company; the role may be missing.

    A block whose first two lines are bullets, or whose first three lines name no role, company, bar, ``at`` or ``in``, tells of no job;
    neither does one about a certificate.
    """
    today = F.lit(as_of).cast("date")
    read = read_groups(blocks(sections, key, content, today), key)
    first = F.get("lines", F.lit(0))["line"]
    company = F.coalesce("company", wl.remainder_company(first, F.col("role")))
    speaks = F.exists("lines", lambda x: F.coalesce(x["bare"].rlike(wl.HAS_ROLE) | x["bare"].rlike(wl.HAS_COMPANY) | x["bare"].rlike(r"(?i) at | in |\|"), F.lit(False)))
    span = F.get(F.flatten(F.transform("lines", lambda x: x["spans"])), F.lit(0))
    good = read.filter(~F.col("bullets") & speaks).withColumn("company", company).filter("company is not null")
    certificate = rf"(?i)\b(?:{wl.CERTIFICATE_WORDS})\b"
    good = good.withColumn("role", F.when(~wl.is_skill(F.col("role")), F.col("role")))
    good = good.filter(~F.coalesce(F.col("role").rlike(certificate), F.lit(False)) & ~F.col("company").rlike(certificate))
    dated = good.select("*", span.alias("span"), _described(wl.RANGE).alias("description"))
    return _entry(dated.select(key, "part", "company", "role", "span.start", "span.end", F.col("span.current").alias("is_current"), "description"), key, "part")


def line_entries(sections: DataFrame, key: str, content: str, as_of: str) -> DataFrame:
    """Entries of the second layer: one for each range of dates in a line, with or without a company or a role."""
    today = F.lit(as_of).cast("date")
    read = read_groups(surroundings(sections, key, content, today), key)
    guess = F.get(F.filter(F.transform("lines", lambda x: wl.role_and_company(x["bare"])), lambda g: g.isNotNull()), F.lit(0))
    both = read.withColumn("guess", guess).withColumn("own_role", F.coalesce("role", "guess.role")).withColumn("own_company", F.coalesce("company", "guess.company"))
    # a role that holds a company too is split
    both = both.withColumn("split", F.when(F.col("own_company").isNull(), wl.role_and_company(F.col("own_role"))))
    company = F.coalesce("own_company", "split.company")
    both = both.withColumn("role", F.coalesce("split.role", "own_role")).withColumn("company", F.when(~company.rlike(wl.DATE_LIKE), company))
    spans = F.get("lines", F.lit(0))["spans"]
    each = both.select(key, "part", "company", "role", F.posexplode(spans).alias("k", "span"), _described(wl.DATE_LIKE).alias("description"))
    entries = each.select(key, F.struct("part", "k").alias("part"), "company", "role", "span.start", "span.end", F.col("span.current").alias("is_current"), "description")
    return distinct_entries(_entry(entries, key, "part"), key, "part")


def listed_entries(sections: DataFrame, key: str, content: str, as_of: str) -> DataFrame:
    """Labelled entries, entries of one line, and entries told in a sentence."""
    today = F.lit(as_of).cast("date")
    text, year = F.col(content), int(as_of[:4]) + 2
    lists = F.concat(h.labelled_entries(text, year), h.inline_entries(text, today), h.prose_entries(text, today))
    each = sections.select(key, F.posexplode(lists).alias("k", "e"))
    end = F.coalesce("e.end", today)
    told = each.select(key, F.col("k").alias("part"), "e.company", "e.role", "e.start", end.alias("end"), F.col("e.is_current").alias("is_current"), "e.description")
    held = told.filter(F.col("start").isNotNull() & (F.col("start") <= today) & (F.trunc("end", "month") <= F.trunc(today, "month")) & (F.col("end") >= F.col("start")))
    return _entry(held, key, "part")


def first_layer_entries(sections: DataFrame, key: str, content: str, as_of: str) -> DataFrame:
    """Labelled entries, then those of blocks, then those of one line and of prose, each once."""
    place = lambda source: F.struct(F.lit(source).alias("source"), F.col("part").cast("long").alias("part")).alias("part")
    columns = ("company", "role", "start", "end", "is_current", "months", "confidence", "description")
    listed = listed_entries(sections, key, content, as_of).select(key, place(0), *columns)
    of_blocks = block_entries(sections, key, content, as_of).select(key, place(1), *columns)
    return distinct_entries(listed.unionByName(of_blocks), key, "part")


def summary(entries: DataFrame, key: str) -> DataFrame:
    """(key, n, months, confidence, current, list): of each résumé's entries the months without overlap and the latest entry."""
    rank = F.struct("is_current", "end", "start", F.struct(*[F.col(x) for x in ("company", "role", "start", "end", "is_current", "confidence")]).alias("e"))
    spans = F.collect_list(F.struct("start", "end"))  # the entries of one section
    grouped = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n"), spans.alias("spans"), F.round(F.avg("confidence"), 2).alias("confidence"), F.max(rank)["e"].alias("current"))
    return grouped.select(key, "n", wl.merged_months(F.col("spans")).alias("months"), "confidence", "current")


def total_experience(sections: DataFrame, key: str, content: str, as_of: str) -> DataFrame:
    """(key, layer, entries, months, years, duration, company, role, since, confidence, needs_review) of each section.

    The second layer counts where ``use_second_layer`` says so.  Beyond ``MOST_MONTHS`` nothing is believed.
    """
    first = summary(first_layer_entries(sections, key, content, as_of), key)
    second = summary(line_entries(sections, key, content, as_of), key)
    name = lambda frame, p: frame.select(key, *[F.col(x).alias(f"{p}_{x}") for x in ("n", "months", "confidence", "current")])
    both = sections.select(key).join(name(first, "a"), key, "left").join(name(second, "b"), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    names = lambda c: c["company"].isNotNull() | c["role"].isNotNull()
    later = use_second_layer(
        zero(F.col("a_n")), zero(F.col("b_n")), zero(F.col("a_months")), zero(F.col("b_months")), F.col("a_current").isNotNull(),
        F.coalesce(names(F.col("b_current")), F.lit(False)), F.coalesce("a_confidence", F.lit(0.0)), F.coalesce("b_confidence", F.lit(0.0)),
    )
    chosen = both.withColumn("later", later)
    of = lambda x: F.when(F.col("later"), F.col(f"b_{x}")).otherwise(F.col(f"a_{x}"))
    chosen = chosen.select(key, "later", zero(of("n")).alias("n"), zero(of("months")).alias("months"), of("confidence").alias("confidence"), of("current").alias("current"))
    far = F.col("months") > MOST_MONTHS
    months, current = F.when(far, 0).otherwise(F.col("months")), F.when(~far, F.col("current"))
    n = F.when(far, 0).otherwise(F.col("n"))
    return chosen.select(
        key,
        F.when(F.col("later"), "layer2").otherwise("layer1").alias("layer"),
        n.cast("long").alias("entries"),
        months.cast("long").alias("months"),
        F.when(months > 0, F.round(months / 12, 1)).alias("years"),
        F.when(months > 0, duration_text(months)).otherwise("").alias("duration"),
        current["company"].alias("company"),
        current["role"].alias("role"),
        F.date_format(current["start"], "yyyy-MM").alias("since"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        ((n > 0) & (months == 0)).alias("needs_review"),
    )
