"""Names and places of résumés: candidates of lines with their source, ranked; places by a gazetteer.

Every line of a résumé's head may say a name in several ways; each way is a source with a rank.  Of all that hold, the one of the best rank and
then of the earliest line counts.  For places, the words of the head's lines are joined with the first words of a
gazetteer's lower-cased spellings, of one to ``MOST_PLACE_WORDS`` words, and the rest compared, so it may have any size and is broadcast only where the planner finds it small.

Defined cases: a null or empty text has no name and no place (empty strings); a spelling that the gazetteer has twice counts by its smaller
canonical form; ties go to the earlier line, then the longer spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as k
from ..functions import scoring as sc
from ..functions import sections as s
from ..functions import text as t
from ..functions.arrays import distinct_ignoring_case, let
from ..sources.shared import shared_folder

# How many lines of a head are looked at by each source of a name, what labels a field, and words of documents' titles.
HEAD, FIRST, FEW, MANY = 2, 3, 5, 40
LABELS = ("email", "phone", "mobile", "contact", "location", "address", "linkedin", "github", "portfolio", "website", "dob", "nationality")
TITLES = r"(?i)\b(?:resume|curriculum vitae|cv|profile|summary|objective|skills|experience|education|projects|certifications|references|contact|declaration)\b"
ROLE_NOISE = r"(?i)\b(?:engineer|analyst|developer|tester|consultant|manager|specialist|architect)\b"
NO_PLACE_LINE = r"(?i)^(?:languages?|known|nationality)\b"
TECHNICAL_LINE = r"(?i)\b(?:technology|project|responsibilit|power apps|power automate|dataverse|sharepoint)\b"
MOST_PLACE_WORDS, PLACE_LINES = 3, 25
#: What says that a place follows; the label counts before the phrase, and both before a bare line.
LABELLED = r"(?i)\b(?:current\s+location|location|address|city|place)\s*[:\-]"
TOLD = r"(?i)\b(?:based\s+in|living\s+in|located\s+in|residing\s+in|relocate\s+to)\b"


def head_lines(text: Column, most: int = MANY) -> Column:
    """The first lines that are not blank, with single blanks."""
    # whole texts are cut to lines once; only the first lines are rewritten
    lines = F.filter(F.split(t.line_breaks(text), "\n"), lambda x: F.trim(x) != "")
    return F.transform(F.slice(lines, 1, most), lambda x: F.trim(F.regexp_replace(x, rf"[{t.BLANK}]+", " ")))


def bare_name(line: Column) -> Column:
    """A line up to a bar, a bullet, a number or an address, without a label, up to the first word that no name has; five words at most."""
    c = F.regexp_replace(F.regexp_replace(line, r"^[ ,.\-]+|[ ,.\-]+$", ""), r"(?i)^(?:full\s+)?name\s*[:\-]\s*", "")
    c = F.get(F.split(c, r"\s+\|\s+|\s+[·•]\s+|\s+-\s+|, (?=\+?\d|[A-Za-z0-9._%+-]+@)", 2), F.lit(0))
    # a name has at most four words, so a fifth tells that a line is none
    words = F.transform(F.slice(F.split(F.trim(c), " "), 1, 5), lambda w: F.regexp_replace(w, r"^[ ,.\-:]+|[ ,.\-:]+$", ""))
    stops = lambda ws: F.array_position(F.transform(ws, lambda w: F.lower(w).isin(*LABELS) | w.rlike(r"\d|@") | (w == "")), F.lit(True)).cast("int")
    return let(words, lambda ws: let(stops(ws), lambda n: F.array_join(F.when(n > 0, F.slice(ws, F.lit(1), n - 1)).otherwise(ws), " ")))


def is_name(c: Column) -> Column:
    """Two to four words, nearly all capitalised, that name no document, role, company or tool and have no other marks."""
    n = F.size(F.split(c, " "))
    capital = F.size(F.filter(F.split(c, " "), lambda w: w.rlike(r"^[A-Z][A-Za-z'`.-]+$")))
    bad = c.rlike(TITLES) | c.rlike(k.word(k.COMPANY_WORDS)) | c.rlike(k.word(k.ROLE_WORDS)) | c.rlike(k.word(k.TECHNICAL)) | c.rlike(r"[\d@/:;|()\[\]{}<>_#*,]")
    # words are counted before the long lists of words are searched for
    return (c != "") & n.between(2, 4) & (capital >= F.greatest(F.lit(2), n - 1)) & ~bad


def formatted(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")


def name_candidates(text: Column) -> Column:
    """(rank, place, name) of all readings that hold: labelled, first lines, capitals, leading words, any line of the head."""

    def of_line(x: Column, i: Column) -> Column:
        leading = F.regexp_extract(x, r"^([A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,3})\b", 1)
        holds = lambda c: F.when(is_name(c), c)  # noqa: E731  each reading is judged once, whatever ranks it has
        first = let(F.when(i < FEW, leading), lambda c: F.when(~c.rlike(ROLE_NOISE), holds(c)))
        return let(F.struct(let(bare_name(x), holds).alias("bare"), first.alias("leading")), lambda s: ranked(x, i, s["bare"], s["leading"]))

    def ranked(x: Column, i: Column, bare: Column, leading: Column) -> Column:
        rank = (
            (0, x.rlike(r"(?i)^(?:full\s+)?name\s*[:\-]"), bare),
            (1, i < HEAD, bare),
            (2, (i < FIRST) & (F.upper(bare) == bare), bare),
            (3, F.lit(True), leading),
            (4, i < FEW, bare),
            (5, F.lit(True), bare),
        )
        each = [F.when(c.isNotNull() & where, F.struct(F.lit(r).alias("rank"), i.cast("int").alias("place"), c.alias("name"))) for r, where, c in rank]
        return F.when(bare.isNotNull() | leading.isNotNull(), F.array_compact(F.array(*each))).otherwise(F.slice(F.array(*each[:1]), 1, 0))

    lines = F.filter(head_lines(text), lambda x: ~x.rlike(NO_PLACE_LINE))
    return F.flatten(F.transform(lines, of_line))


def best_name(text: Column) -> Column:
    """The name of the best reading, capitalised; empty without one."""
    return F.coalesce(formatted(F.array_min(name_candidates(text))["name"]), F.lit(""))


def places(rows: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(key, source, place): the canonical form, in ``gazetteer`` (spelling, canonical), of the place that a résumé's head names first.

    Labelled lines come first, then phrases (``based in``), then bare lines; in a line the earliest spelling, and of these the longest.
    """
    lines = F.slice(head_lines(F.col(text)), 1, PLACE_LINES)
    each = rows.select(key, F.posexplode(lines).alias("line", "x"))
    each = each.filter(~F.col("x").rlike(NO_PLACE_LINE) & ~F.col("x").rlike(TECHNICAL_LINE))
    mark = F.when(F.col("x").rlike(LABELLED), 0).when(F.col("x").rlike(TOLD), 1).otherwise(2)
    after = F.when(mark == 0, F.regexp_replace("x", rf"^.*?{LABELLED}", "")).when(mark == 1, F.regexp_replace("x", rf"^.*?{TOLD}", "")).otherwise(F.col("x"))
    words = F.filter(F.split(F.lower(after), r"[^\p{L}.'-]+"), lambda w: w != "")
    told = each.select(key, "line", mark.alias("source"), words.alias("w"))
    starts = F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("first"), F.slice("w", i + 1, F.lit(MOST_PLACE_WORDS)).alias("span")))
    begun = told.select(key, "line", "source", F.explode(starts).alias("r")).select(key, "line", "source", "r.*")
    known = gazetteer.groupBy(F.lower(F.trim("spelling")).alias("spelling")).agg(F.min("canonical").alias("canonical"))
    known = known.withColumns({"first": F.split_part("spelling", F.lit(" "), F.lit(1)), "n": F.size(F.split("spelling", " "))}).filter(F.col("n") <= MOST_PLACE_WORDS)
    both = begun.join(known, "first").filter((F.size("span") >= F.col("n")) & (F.array_join(F.slice("span", F.lit(1), F.col("n")), " ") == F.col("spelling")))
    spelled = both.select(key, F.struct("source", "line", "at", (-F.col("n")).alias("n")).alias("rank"), "canonical")
    found = spelled.groupBy(key).agg(F.min(F.struct("rank", "canonical")).alias("b"))
    sources = F.array(*[F.lit(x) for x in ("label", "phrase", "line")])
    best = found.select(key, F.get(sources, F.col("b.rank.source")).alias("source"), F.col("b.canonical").alias("place"))
    return rows.select(key).join(best, key, "left").select(key, F.coalesce("source", F.lit("")).alias("source"), F.coalesce("place", F.lit("")).alias("place"))


# Fixed value: below this confidence a field is read once more.
RETRY = 0.7


def first_pass(rows: DataFrame, key: str, text: str, dictionary: list[str]) -> DataFrame:
    """(key, name, email, location, skills, confidences, head, section): the fields of résumés as they are read at first.

    A location must stand as ``City, Country`` in a line of the head; skills must be items of a skills section that ``dictionary`` has.
    """
    c, known = F.col(text), F.array(*[F.lit(x.lower()) for x in dictionary])
    read = rows.select(
        key,
        best_name(c).alias("name"),
        k.valid_email(F.regexp_extract(F.coalesce(c, F.lit("")), t.EMAIL, 0)).alias("email"),
        k.place_of_resume(F.array_join(head_lines(c, PLACE_LINES), "\n")).alias("location"),
        F.array_join(head_lines(c, PLACE_LINES), "\n").alias("head"),
        s.content_of(c, "skills").alias("section"),
    )
    items = F.transform(F.split("section", r"[\n,;|•]+"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*]+", "")))
    own = distinct_ignoring_case(F.filter(items, lambda x: F.array_contains(known, F.lower(x))))
    read = read.withColumn("skills", own)
    return read.select(
        "*",
        k.name_confidence(F.col("name")).alias("name_confidence"),
        k.location_confidence(F.col("location")).alias("location_confidence"),
        sc.skill_confidence(F.col("skills"), F.col("skills"), F.col("section") != "").alias("skills_confidence"),
    )


def parsed(rows: DataFrame, key: str, text: str, dictionary: list[str], gazetteer: DataFrame) -> DataFrame:
    """(key, name, email, location, skills, confidence, retried): fields of all résumés after at most one more reading of those that are unsure.

    Fields below ``RETRY`` are read again: such a name is left blank, a location is looked up in the gazetteer over the head, and words of
    the skills section that the dictionary has join the skills.  The first reading is a checkpoint that holds no whole text; only
    its unsure rows go through the gazetteer's join, whose result comes back by one join on the key.  ``retried`` names the fields.
    """
    return read_again(first_reading(rows, key, text, dictionary), key, dictionary, gazetteer)


def first_reading(rows: DataFrame, key: str, text: str, dictionary: list[str]) -> DataFrame:
    """The first pass, worked out once and kept as a checkpoint for all that comes of it."""
    shared_folder(rows.sparkSession)  # where the checkpoint goes
    return first_pass(rows, key, text, dictionary).checkpoint()


def read_again(first: DataFrame, key: str, dictionary: list[str], gazetteer: DataFrame) -> DataFrame:
    """The second reading of ``parsed`` over the kept first one."""
    low = lambda name: F.col(f"{name}_confidence") < RETRY
    again = places(first.filter(low("location")), key, "head", gazetteer).filter("place <> ''").select(key, "place")
    pattern = "|".join(rf"\Q{x}\E" for x in sorted(dictionary, key=len, reverse=True))
    words = F.regexp_extract_all("section", F.lit(rf"(?i)(?<!\w)({pattern})(?!\w)"), F.lit(1))
    more = F.when(low("skills"), distinct_ignoring_case(F.concat("skills", words))).otherwise(F.col("skills"))
    both = first.join(again, key, "left")
    location = F.when(low("location"), F.coalesce("place", "location")).otherwise(F.col("location"))
    retried = F.array_compact(F.array(*[F.when(low(n), n) for n in ("name", "location", "skills")]))
    sure = F.round((F.col("name_confidence") + F.col("location_confidence") + F.col("skills_confidence")) / 3, 3)
    return both.select(key, F.when(low("name"), "").otherwise(F.col("name")).alias("name"), "email", location.alias("location"), more.alias("skills"), sure.alias("confidence"), retried.alias("retried"))
