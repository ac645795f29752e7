"""Sections of a résumé as column expressions over its lines: no row moves, a text of any length stays one row.

A line opens a section where it is ``Header: content`` or looks like a header, by a name, or by the words that it begins
with.  Lines before the first opening, of the first twelve, are the header; a boundary header closes a section and opens none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .arrays import let

# Sections in their order, and the terms of each; terms of an earlier section come first.
SECTIONS = ("experience", "skills", "education", "projects", "header", "contact", "summary", "languages", "achievements", "certifications", "awards", "publications", "interests", "references")
TERMS = {
    "summary": "summary|professional summary|profile summary|career summary|professional overview|executive summary|objective|profile",
    "contact": "contact|contact details|contact information|personal details|personal information",
    "skills": "skills|technical skills|core skills|key skills|competencies|primary skills|tools|technologies|technical expertise|expertise|tool stack|tech stack|tools and technologies|technical competencies|areas of expertise|technology stack|professional skills|core competencies",
    "experience": "experience|work experience|professional experience|employment|employment history|career history|work history|internships|internship experience|professional background|previous experience|prior experience|period",
    "education": "education|academic background|academic profile|qualification|qualifications|education details|academic qualifications|educational qualifications",
    "projects": "projects|project|personal projects|work projects|professional projects|project profile|project experience|academic projects",
    "certifications": "certifications|certification|certificates|certificate|licenses|licences|licenses and certifications|professional certification|professional certifications",
    "achievements": "achievements|achievement|awards|award|accomplishments|key product launches",
    "publications": "publications|publication|research publications",
    "languages": "languages|language skills|spoken languages|language proficiency|language|linguistic proficiency",
    "awards": "award|awards",
    "interests": "interest|interests",
    "references": "reference|references",
}
# Further names, which count before all others.
NAMES = {
    "summary": "career profile|professional profile",
    "experience": "experience summary|employment details|career journey",
    "skills": "skill set|technology tools",
}
BOUNDARIES = "certifications?|awards?|achievements?|key product launches|publications?|interests?|references?|internships?"
CONTACT = "email|phone|mobile|location|address"
HEAD_LINES, HEAD_KEPT = 12, 10


def plain_line(c: Column) -> Column:
    """Dashes and bullets in plain form, single blanks, none at the ends."""
    plain = c
    c = F.translate(c, "–—―•▪◦· \r", "---     ")
    for torn, to in ((t.TORN_DASHES, "-"), (t.TORN_BULLETS, " ")):
        for x in torn:
            c = F.replace(c, F.lit(x), F.lit(to))
    # most lines have none of these marks, and single blanks
    c = F.when(~plain.rlike(r"[^\x00-\x7F]|\r"), plain).otherwise(c)
    return t.stripped(F.regexp_replace(c, "\t[ \t]*| [ \t]+", " "))


def header_words(line: Column) -> Column:
    """The letters of what may be a header, lower-cased; ``line`` is plain."""
    c = F.regexp_replace(line, r"^[\s|_\-=~*#.:]+|[\s|_\-=~*#.:]+\z", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z\s-]", " "), "[ \t]+", " ")
    return F.lower(F.regexp_replace(c, r"^[ -]+|[ -]+\z", ""))


def section_of(words: Column) -> Column:
    """The section that header words name, or begin with; else null."""
    own = {term: s for group in (TERMS, NAMES) for s, terms in group.items() for term in terms.split("|")}
    own |= {term: s for s, terms in reversed(TERMS.items()) for term in terms.split("|")}
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), words)
    begun = F.coalesce(*[F.when(words.rlike(rf"^(?:{terms})\b"), s) for s, terms in TERMS.items()])
    return F.when(words != "", F.coalesce(named, begun))


def rest_of_header(line: Column, section: Column) -> Column:
    """What follows the words that open a section in the same line, unless that names a section too."""
    out = F.lit("")
    for s, terms in TERMS.items():
        out = F.when(section == s, F.regexp_extract(line, rf"(?i)^(?:{terms})\b[ :\-|]*(.*?)[ :\-|]*\z", 1)).otherwise(out)
    return let(out, lambda x: F.when(section_of(header_words(x)).isNull(), x).otherwise(""))


#: The first words of all names and terms: a line whose letters begin with none of them opens and closes nothing.
FIRST_WORDS = sorted({re.split(r"[ ?]", x)[0] for group in (TERMS, NAMES) for terms in group.values() for x in terms.split("|")} | {re.split(r"[ ?]", x)[0].removesuffix("s") for x in BOUNDARIES.split("|")})
MAY_OPEN = rf"(?i)^[^A-Za-z]*+(?:{'|'.join(FIRST_WORDS)})"


def _opening(line: Column, place: Column) -> Column:
    """(place, section, content, inline) of a line that opens a section; a boundary has none; else null."""
    pattern = r"^([^:]{1,60}?):\s*(.+)\z"

    def judged(s: Column) -> Column:
        words, inline = s["words"], s["inline"]
        looks = (words != "") & (F.size(F.split(words, r"\s+")) <= 6)
        section = F.when(looks, s["whole"])
        of = lambda a, b, c: F.struct(place.cast("int").alias("place"), a.alias("section"), b.alias("content"), c.alias("inline"))
        no = F.lit(None).cast("string")
        return (
            F.when(inline.isNotNull(), of(inline, F.trim(F.regexp_extract(line, pattern, 2)), F.lit(True)))
            .when(section.isNotNull(), of(section, rest_of_header(line, section), F.lit(False)))
            .when(looks & words.rlike(f"^(?:{BOUNDARIES})$"), of(no, F.lit(""), F.lit(False)))
        )

    head = F.regexp_extract(line, pattern, 1)
    short = lambda w: F.size(F.split(w, r"\s+")) <= 6  # noqa: E731  longer lines are no headers
    inline = F.when(line.contains(":"), let(header_words(plain_line(head)), section_of))
    known = let(header_words(line), lambda w: F.struct(w.alias("words"), F.when(short(w), section_of(w)).alias("whole"), inline.alias("inline")))
    return let(known, judged)


def _cleaned(lines: Column) -> Column:
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*[-*•▪◦·]+\s*", ""))
    return t.stripped(F.regexp_replace(F.array_join(bare, "\n"), "\n{3,}", "\n\n"))


def segmented(c: Column, wanted: Sequence[str] = SECTIONS) -> Column:
    """A list of (section, content), in the order of ``wanted``, of these sections that have content."""
    lines = F.transform(F.split(t.line_breaks(c), "\n"), plain_line)
    return let(lines, lambda own: let(F.filter(F.transform(own, lambda x, i: F.when(x.rlike(MAY_OPEN), _opening(x, i))), lambda o: o.isNotNull()), lambda opens: _divided(own, opens, wanted)))


def _divided(lines: Column, every: Column, wanted: Sequence[str]) -> Column:
    """``Languages: ...`` inside the skills does not open a section."""

    def opens(o: Column) -> Column:
        tongue = lambda x: x["inline"] & (F.coalesce(x["section"], F.lit("")) == "languages")
        before = F.filter(every, lambda x: (x["place"] < o["place"]) & ~tongue(x))
        return ~(tongue(o) & (F.coalesce(F.try_element_at(before, F.lit(-1))["section"], F.lit("")) == "skills"))

    def parts(own: Column) -> Column:
        first = F.coalesce(F.get(own, F.lit(0))["place"], F.lit(1 << 30))
        spans = F.transform(own, lambda o, k: _span(lines, o, F.coalesce(F.get(own, k + 1)["place"], F.size(lines))))
        head = F.filter(F.slice(lines, F.lit(1), F.least(first, F.lit(HEAD_LINES), F.size(lines))), lambda x: x != "")
        return let(spans, lambda all_: contents(all_, head))

    def contents(spans: Column, head: Column) -> Column:
        more = F.flatten(F.transform(F.filter(spans, lambda s: s["section"] == "summary"), lambda s: s["head"]))
        named = lambda name: F.flatten(F.transform(F.filter(spans, lambda s: s["section"] == name), lambda s: s["lines"]))
        content = lambda name: _cleaned(F.slice(F.concat(head, more), 1, HEAD_KEPT) if name == "header" else named(name))
        return F.filter(F.array(*[F.struct(F.lit(s).alias("section"), content(s).alias("content")) for s in wanted]), lambda s: s["content"] != "")

    return let(F.filter(every, opens), parts)


def _span(lines: Column, o: Column, end: Column) -> Column:
    """(section, lines, head) of an opening up to the next; contact lines of an early summary belong to the header."""
    some = F.slice(lines, o["place"] + 2, F.greatest(end - o["place"] - 1, F.lit(0)))
    early = lambda x, i: (o["section"] == "summary") & (o["place"] + 1 + i < HEAD_LINES) & x.rlike(rf"(?i)^(?:{CONTACT})\b")
    own = F.filter(some, lambda x, i: ~F.coalesce(early(x, i), F.lit(False)))
    first = F.when(o["content"] != "", F.array(o["content"])).otherwise(F.array().cast("array<string>"))
    return F.struct(o["section"].alias("section"), F.concat(first, own).alias("lines"), F.filter(some, lambda x, i: F.coalesce(early(x, i), F.lit(False))).alias("head"))


def content_of(c: Column, section: str) -> Column:
    """One section's content; empty without it."""
    return F.coalesce(F.try_element_at(segmented(c, (section,)), F.lit(1))["content"], F.lit(""))
