"""Lists: duplicates without regard to case, identity keys, current entries, empty values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often and however deep the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_ignoring_case(c: Column) -> Column:
    """Trimmed items without blank ones; of those that differ only in case the first."""
    items = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    first = lambda own, low: F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return let(items, lambda own: let(F.transform(own, lambda x: F.lower(x)), lambda low: first(own, low)))


def distinct_by(c: Column, fields: Sequence[str]) -> Column:
    """Structs without those whose identity fields are all blank; of equal identities the first."""
    key = lambda s: F.concat_ws("\x1f", *[F.lower(F.trim(F.coalesce(s[f].cast("string"), F.lit("")))) for f in fields])
    full = F.filter(c, lambda s: F.replace(key(s), F.lit("\x1f"), F.lit("")) != "")
    first = lambda own, keys: F.filter(own, lambda s, i: F.array_position(keys, key(s)) == i + 1)
    return let(full, lambda own: let(F.transform(own, key), lambda keys: first(own, keys)))


def skill_list(c: Column) -> Column:
    """A list from a JSON list or from text with commas."""
    parsed = F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>")
    return distinct_ignoring_case(F.coalesce(parsed, F.split(F.coalesce(c, F.lit("")), ",")))


def current_entry(entries: Column) -> Column:
    """The entry that is current, else ended last, else began last; entries have is_current, end and start."""
    ranked = F.transform(entries, lambda e: F.struct(e["is_current"].alias("a"), e["end"].alias("b"), e["start"].alias("c"), e.alias("e")))
    return F.array_max(ranked)["e"]


def overlap(found: Column, expected: Column) -> Column:
    """(hits, missing, unexpected, precision, recall) of two lists without regard to case."""
    a, b = (F.array_distinct(F.transform(x, lambda y: F.lower(F.trim(y)))) for x in (found, expected))
    hits = F.array_intersect(a, b)
    rate = lambda whole: F.round(F.coalesce(F.try_divide(F.size(hits).cast("double"), F.size(whole)), F.lit(0.0)), 4)
    return F.struct(F.size(hits).alias("hits"), F.size(F.array_except(b, a)).alias("missing"), F.size(F.array_except(a, b)).alias("unexpected"), rate(a).alias("precision"), rate(b).alias("recall"))


def json_without_empty(**fields: Column) -> Column:
    """A JSON object without fields that are null, blank or empty lists."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "true"})


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def of_payload(c: Column, name: str) -> Column:
    """A field of a JSON object by its name in either style, ``job_id`` or ``jobId``; empty without it."""
    head, *rest = name.split("_")
    camel = head + "".join(x.capitalize() for x in rest)
    found = [F.nullif(F.get_json_object(c, f"$.{k}"), F.lit("")) for k in (name, camel)]
    return F.coalesce(*found, F.lit(""))


def distinct_lists(df: DataFrame, *names: str) -> DataFrame:
    """The frame with these list fields without items that differ only in case or are blank."""
    return df.withColumns({x: distinct_ignoring_case(F.filter(x, lambda y: y.isNotNull())) for x in names})
