"""Single lines of a work history as column expressions: what dates they hold, and what company or role can be read from them.

A line is rewritten once (``work_line``): wordings of ranges become ``a - b``, ones that still run end in ``Present``.  A reading is a column
that is null where a line has nothing to say; readings stand in order of trust, and the operators take the first one that holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .arrays import let
from .dates import full_year, months_inclusive, valid_span


def any_word(words: str) -> str:
    """The pattern of the same words that tries a letter once for all words that begin with it, and first of all their first letters."""

    def node(rest: list[str]) -> str:
        groups: dict[str, list[str]] = {}
        for w in rest:
            groups.setdefault(w[:1] if w[:1].isalpha() else w, []).append(w)
        parts = [same[0] if len(same) == 1 else first + node([w[1:] for w in same]) for first, same in groups.items()]
        return f"(?:{'|'.join(parts)})"

    own = list(dict.fromkeys(words.split("|")))
    return f"(?=[{''.join(sorted({w[0] for w in own}))}]){node(own)}"


# Months, words for a job that still runs, and the forms of a date, the more exact ones first.
MONTH = r"(?:jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december)"
PRESENT = r"(?:present|current|currently|now|today|ongoing|till date|till now|till-date|tilldate)"
STILL = r"(?:present|current|currently|now|today|ongoing|continuing|till date|till now|till-date|tilldate|to date|date)"
DATE_FORMS = (
    rf"{MONTH}[.\-/\s,'’]+\d{{2,4}}",
    rf"\d{{1,2}}[.\-/\s]{MONTH}[.\-/\s,'’]+\d{{2,4}}",
    rf"{MONTH}[.\-/\s,'’]+\d{{1,2}}(?:st|nd|rd|th)?[,\s.\-/]+\d{{2,4}}",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{1,2}[/-]\d{2,4}",
    r"\d{4}\.\d{1,2}",
    r"\d{4}[/-]\d{1,2}",
    r"\d{1,2}\.\d{2,4}",
    r"\d{4}",
)
# a form begins with a digit or a month; those of one beginning stay in order, and most places of a text begin none
_OF_MONTHS = [x for x in DATE_FORMS if x.startswith(MONTH)]
_OF_DIGITS = [x for x in DATE_FORMS if not x.startswith(MONTH)]
MONTH_BEGINS = r"(?=[jfmasond])(?=j(?:an|u[nl])|feb|ma[ry]|a(?:pr|ug)|sep|oct|nov|dec)"
DATE = rf"(?:(?=\d)(?:{'|'.join(_OF_DIGITS)})|{MONTH_BEGINS}(?:{'|'.join(_OF_MONTHS)}))"
FISCAL = r"(?:FY|AY)\s*\d{4}(?:[-/]\d{2,4})?"
# Words of roles, what may stand before them in a title, companies, skills, certificates, actions and places.
ROLE_WORDS = "engineer|developer|manager|lead|analyst|consultant|architect|specialist|administrator|designer|executive|director|officer|associate|scientist|recruiter|sales|product|qa|tester|intern|teacher|partner|coordinator"
TITLE_WORDS = "engineer|developer|manager|lead|analyst|consultant|architect|specialist|administrator|designer|executive|director|officer|associate|scientist|recruiter|sales|product|qa|tester|intern|teacher|partner|generalist|coordinator"
TITLE_HEADS = "senior|sr|junior|jr|lead|principal|staff|associate|assistant|frontend|front-end|backend|back-end|full[- ]stack|data|product|software|web|mobile|qa|devops|machine learning|ml|human resources|hr|engineering|business|intelligence|sales|sap|mathematics"
LEADING_WORDS = "engineer|developer|manager|lead|analyst|consultant|architect|specialist|administrator|designer|executive|director|officer|associate|scientist|recruiter|tester|teacher|partner|generalist|coordinator"
LEADING_HEADS = "senior|sr|junior|jr|lead|principal|staff|associate|assistant|graphic|brand|visual|creative|content|product|frontend|front-end|backend|back-end|full[- ]stack|data|software|web|mobile|qa|devops|machine learning|ml|human resources|hr|engineering|business|intelligence|sales|marketing|customer|growth"
TOLD_BEFORE = r"i\s+was|worked\s+as|work(?:ed)?\s+as|joined\s+as|served\s+as|role\s+was|position\s+was"
COMPANY_WORDS = "pvt|ltd|inc|llc|llp|technologies|solutions|corp|corporation|organisation|organization|systems|labs|works|school|college|university|academy|institute|services"
COMPANY_FORMS = r"Pvt\.?\s+Ltd\.?|Ltd\.?|Inc\.?|Corp\.?|Corporation|Technologies|Solutions|Systems|Labs|Works|LLP|Services|School|College|University|Institute"
NO_COMPANY_WORDS = "strategy|analytics|marketing|platform|pipeline|roadmap|adoption|enterprise"
SKILL_WORDS = r"python|java|javascript|typescript|react|angular|vue|node(?:\.js)?|fastapi|django|flask|sql|aws|azure|gcp|docker|kubernetes|seo|crm|machine learning"
CERTIFICATE_WORDS = "certified|certification|certificate|ccna|azure fundamentals|associate - back-end"
ACTION_WORDS = "designed|built|led|owned|managed|partnered|created|developed|delivered|reduced|defined|ran|spearheaded|implemented|launched|using"
PLACES = ("maharashtra", "tamil nadu", "bangalore", "bengaluru", "hyderabad", "karnataka", "gurugram", "chennai", "haryana", "mumbai", "remote", "delhi", "india", "noida", "pune")
TRAILING_PLACES = "Bengaluru|Bangalore|Chennai|Hyderabad|Pune|Mumbai|Delhi|Gurugram|Noida|Karnataka|Tamil Nadu|Maharashtra|Haryana"
SECTION_NAMES = r"experience|work experience|professional experience|employment history|career history|professional background|work history|experience summary|employment|period"
OTHER_SECTIONS = (
    "certifications?|soft skills?|technical skills|skills|education|projects?|languages?|profile summary|summary|professional summary|profile|job objective|objective|"
    "career objective|publications?|interests?|awards?|achievements?|personal info(?:rmation)?|personal details|contact details|areas of expertise"
)
INTERN_WORDS = "intern|internship|trainee|apprentice"

HAS_ROLE = rf"(?i)\b{any_word(ROLE_WORDS)}\b"
HAS_COMPANY = rf"(?i)\b{any_word(COMPANY_WORDS)}\b"
HAS_ACTION = rf"(?i)\b{any_word(ACTION_WORDS)}\b"
HAS_NO_COMPANY = rf"(?i)\b{any_word(NO_COMPANY_WORDS)}\b"
HAS_TITLE = rf"(?i)\b{any_word(TITLE_WORDS)}\b"
TITLE = rf"(?i)\b((?:{any_word(TITLE_HEADS)}\s+){{0,4}}{any_word(TITLE_WORDS)})\b"
LEADING = rf"(?i)^((?:{any_word(LEADING_HEADS)}\s+){{0,5}}{any_word(LEADING_WORDS)})\b"
TOLD_ROLE = rf"(?i)\b(?=[iwjsrp])(?:{TOLD_BEFORE})\s+(?:an?\s+)?([A-Za-z][A-Za-z/&\-\s]{{1,80}}?(?:{TITLE_WORDS}))\b"
PLACE_TAIL = r"\s+-\s+[A-Z][A-Za-z.\s]+(?:,\s*[A-Z][A-Za-z.\s]+)?(?:\s*/\s*Remote)?$"
NAME = r"^[A-Z][A-Za-z0-9&.'-]{2,}$"
BULLET = r"^\s*[\x{2022}\x{25AA}\x{25E6}\x{25CF}\x{B7}\-*]+\s*"
RANGE = rf"(?i)({DATE})\s*(?:-|–|—|to|until|through)\s*({PRESENT}|{DATE})"
WIDER = rf"(?i)({DATE}|{FISCAL})\s*(?:-|–|—|to|till|until|through|~)\s*({STILL}|{DATE}|{FISCAL})"
SENTENCE = rf"(?i)\b(?:worked\s+from|from|joined|starting|started)\s+({DATE})\b(?:.*?\b(?:to|till|until|through)\b\s+({STILL}|{DATE}))?"
TOLD_FROM = r"(?i)\b(?=[wfjs])(?:worked\s+from|from|joined|starting|started)\s+"
DATE_LIKE = rf"(?i)\b(?:{DATE}|{FISCAL}|{STILL})\b"
#: Wordings of ranges, and what they become; in this order.
REWRITES = (
    (rf"(?i)[\[(]\s*({DATE}|{FISCAL})\s*[\])]", "$1"),
    (r"(?i)\bfrom\s+", ""),
    (r"(?i)\b(?:till date|till now|till-date|tilldate|to date|continuing)\b", "Present"),
    (rf"(?i)({DATE}|{FISCAL})\s+/\s+({DATE}|{STILL}|{FISCAL})", "$1 - $2"),
    (rf"(?i)\bjoined\s+({DATE})\s+and\s+worked\s+until\s+({DATE}|{STILL})", "$1 - $2"),
    (rf"(?i)\bworked\s+from\s+({DATE})\s+to\s+({DATE}|{STILL})", "$1 - $2"),
    (rf"(?i)\b(?:since|from|starting)\s+({DATE}|{FISCAL})\b", "$1 - Present"),
    (rf"(?i)\b({DATE}|{FISCAL})\s*(?:-|–|—|~)\s*$", "$1 - Present"),
    (rf"(?i)({DATE}|{PRESENT})\s+\?\s+({DATE}|{PRESENT})", "$1 - $2"),
    (r"\s+\?\s+", " | "),
)
#: Those that may fit a line without a digit; the last two only one with a question mark.
UNDATED = (REWRITES[1], REWRITES[2], REWRITES[8], REWRITES[9])


def work_line(c: Column) -> Column:
    """A line with plain dashes and single blanks, ranges in one wording, and no number, bar or hyphen at its ends."""

    def reworded(x: Column) -> Column:
        # most lines have neither a digit nor a wording of a date
        some = x.rlike(r"(?i)(?=[\d dncft])(?:\d| \? |\b(?:date|now|continuing|from)\b|till)")
        return F.when(~some, x).when(x.rlike(r"\d"), _rewritten(x, REWRITES)).when(x.contains("?"), _rewritten(x, UNDATED)).otherwise(_rewritten(x, UNDATED[:2]))

    c = let(F.when(~c.rlike("[‐‑‒–—―·]"), c).otherwise(F.translate(c, "‐‑‒–—―·", "------|")), reworded)
    # a blank between two words stays as it is
    c = F.btrim(F.regexp_replace(c, rf"[{t.BLANK}&&[^ ]][{t.BLANK}]*| [{t.BLANK}]+", " "), F.lit(" |-"))
    return F.trim(F.regexp_replace(c, r"^(?:\d{1,2}\)|\d{1,2}\.\s+)", ""))


def _rewritten(c: Column, wordings: tuple) -> Column:
    for pattern, to in wordings:
        c = F.regexp_replace(c, pattern, to)
    return c


def _month(c: Column) -> Column:
    """The number of a month that is written as a number or a name."""
    names = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])
    return F.coalesce(c.try_cast("int"), F.nullif(F.array_position(names, F.left(F.lower(c), F.lit(3))).cast("int"), F.lit(0)))


def date_of(token: Column, is_end: bool, today: Column) -> Column:
    """The date of a token; the last day of its month or year where it is an end; null if no form fits.

    Forms in order: still running, yyyy.mm, month name, mm/yy, yyyy-mm, fiscal year, span of years, year, day and month with year.
    """

    def group(c: Column, pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))

    def closing(first: Column, last: Column) -> Column:
        """A second year, of two digits in the century of the first or the next; the first without one."""
        n = last.try_cast("int")
        two = F.floor(first.cast("int") / 100).cast("int") * 100 + n
        return F.when(last.isNull(), first.cast("int")).when(F.length(last) != 2, n).when(two < first.cast("int"), two + 100).otherwise(two)

    def built(year: Column, month: Column, day: Column | None = None) -> Column:
        good = year.between(1, 9999) & month.between(1, 12)
        y, m = F.when(good, year), F.when(good, month)
        if day is not None:
            return F.when(good & day.between(1, 31), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, day), "yyyy-MM-dd"))
        first = F.make_date(y, m, F.lit(1))
        return F.last_day(first) if is_end else first

    def read(c: Column) -> Column:
        edge, fits = F.lit(12 if is_end else 1), lambda p, of: F.when(c.rlike(p), of(p))
        number = lambda p, k: group(c, p, k).try_cast("int")
        year_of = lambda p: closing(group(c, p, 1), group(c, p, 2)) if is_end else number(p, 1)
        return F.coalesce(
            F.when(c.rlike(rf"(?i)^{STILL}$"), today),
            fits(r"^\d{4}$", lambda p: built(c.try_cast("int"), edge)),  # no other form fits four digits
            fits(r"^(\d{4})\.(\d{1,2})$", lambda p: built(number(p, 1), number(p, 2))),
            fits(rf"(?i)^({MONTH})[\s'’.\-/,]*(\d{{4}}|\d{{2}})$", lambda p: built(full_year(group(c, p, 2)), _month(group(c, p, 1)))),
            fits(r"^(\d{1,2})[/.-](\d{2,4})$", lambda p: built(full_year(group(c, p, 2)), number(p, 1))),
            fits(r"^(\d{4})[./-](\d{1,2})$", lambda p: built(number(p, 1), number(p, 2))),
            fits(r"(?i)^(?:FY|AY)\s*[- ]?(\d{4})(?:\s*[-/]\s*(\d{2,4}))?$", lambda p: built(year_of(p), edge)),
            fits(r"^(\d{4})\s*[-/]\s*(\d{2,4})$", lambda p: built(year_of(p), edge)),
            fits(rf"(?i)^(\d{{1,2}})[.\-/\s]({MONTH})[.\-/\s,'’]+(\d{{2,4}})$", lambda p: built(full_year(group(c, p, 3)), _month(group(c, p, 2)), number(p, 1))),
            fits(rf"(?i)^({MONTH})[.\-/\s,'’]+(\d{{1,2}})(?:st|nd|rd|th)?[,\s.\-/]+(\d{{2,4}})$", lambda p: built(full_year(group(c, p, 3)), _month(group(c, p, 1)), number(p, 2))),
            fits(r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", lambda p: built(number(p, 3), number(p, 2), number(p, 1))),
        )

    return let(F.trim(F.regexp_replace(token, r"\s+", " ")), read)


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def _spans(pairs: Column, today: Column) -> Column:
    def span(x: Column) -> Column:
        return F.struct(date_of(x["a"], False, today).alias("start"), date_of(x["b"], True, today).alias("end"), x["b"].rlike(rf"(?i)^{STILL}$").alias("current"))

    return F.filter(F.transform(pairs, span), lambda s: valid_span(s["start"], s["end"], today))


def _found(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(k))


NO_PAIRS = "array<struct<a:string,b:string>>"
NO_SPANS = "array<struct<start:date,end:date,current:boolean>>"


def spans(line: Column, today: Column) -> Column:
    """(start, end, current) of the ranges of dates in a rewritten line that are in order and not in the future."""
    # most lines have no digit and are not searched
    return F.when(line.rlike(r"\d"), _spans(_pairs(_found(line, RANGE, 1), _found(line, RANGE, 2)), today)).otherwise(F.array().cast(NO_SPANS))


def wider_spans(line: Column, today: Column) -> Column:
    """The same with fiscal years, sentences (``joined 2010 ... until 2012``, else still running) and a span of years alone; each once."""

    def all_of(c: Column) -> Column:
        ends = F.transform(_found(c, SENTENCE, 2), lambda y: F.when(y == "", "Present").otherwise(y))
        ranges = let(_found(c, WIDER, 1), lambda a: F.when(F.size(a) > 0, _pairs(a, _found(c, WIDER, 2))).otherwise(F.array().cast(NO_PAIRS)))
        told = F.when(c.rlike(TOLD_FROM), _pairs(_found(c, SENTENCE, 1), ends)).otherwise(F.array().cast(NO_PAIRS))
        alone = c.rlike(r"(?i)^(?:(?:FY|AY)\s*[- ]?\d{4}(?:\s*[-/]\s*\d{2,4})?|\d{4}\s*[-/]\s*\d{2,4})$")
        own = F.filter(F.array(F.when(alone, c)), lambda x: x.isNotNull())
        pairs = F.concat(ranges, told, _pairs(own, own))
        return F.array_distinct(_spans(pairs, today))

    return F.when(line.rlike(r"\d"), let(line, all_of)).otherwise(F.array().cast(NO_SPANS))


def without_dates(line: Column) -> Column:
    # a range has a digit
    return trimmed(F.when(line.rlike(r"\d"), F.regexp_replace(line, RANGE, "")).otherwise(line))


def has_range(line: Column) -> Column:
    return line.rlike(r"\d") & line.rlike(RANGE)


def title_of(c: Column) -> Column:
    """The first title in a text; empty without one."""
    return F.when(~c.rlike(HAS_TITLE), "").otherwise(F.regexp_extract(c, TITLE, 1))


def trimmed(c: Column) -> Column:
    """Without blanks, bars, hyphens, commas and colons at the ends."""
    return F.btrim(c, F.lit(" |-,:"))


def first_of(*readings: Column) -> Column:
    """The first reading that says something."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in readings])


def is_company(c: Column) -> Column:
    """Whether a text may be a company's name: a company word, or two capitalised words and more."""
    # what costs least is asked first
    capital = c.contains(" ") & ~c.rlike(r"(?:^| )\p{Ll}")
    return (F.coalesce(c, F.lit("")) != "") & ~c.contains(",") & (capital | c.rlike(HAS_COMPANY)) & ~c.rlike(HAS_ROLE) & ~c.rlike(HAS_ACTION) & ~c.rlike(HAS_NO_COMPANY)


def clean_company(c: Column) -> Column:
    """A company's name without connecting words, the first title in it, years in brackets and places; null if nothing stays."""
    c = F.regexp_replace(c, r"(?i)^(?:worked|working|joined|serving)\s+", "")
    c = F.regexp_replace(c, r"(?i)\b(?:at|with|for)\b\s+", "")
    c = let(c, lambda x: F.when(x.rlike(HAS_TITLE), F.replace(x, F.regexp_extract(x, TITLE, 1), F.lit(" "))).otherwise(x))
    c = F.regexp_replace(c, r"(?i)\(\s*(?:\d{4}\s*(?:-|to)\s*(?:\d{4}|now|present)|digital agency)?\s*\)", "")
    c = F.regexp_replace(c, r"\s*-\s*[A-Z][A-Za-z.\s]+,\s*[A-Z][A-Za-z.\s]+$", "")
    c = F.regexp_replace(c, rf"(?i)\b{any_word('|'.join(PLACES))}\b", "")
    return F.nullif(trimmed(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def parts_of(c: Column, mark: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(c, mark), lambda x: F.trim(x)), lambda x: x != "")


def _part_company(part: Column) -> Column:
    def judged(x: Column) -> Column:
        return F.when(is_company(x) | (x.rlike(NAME) & ~x.rlike(HAS_ROLE)), clean_company(x))

    return let(trimmed(F.regexp_replace(part, PLACE_TAIL, "")), judged)


def _first(xs: Column) -> Column:
    return F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))


def right_of(line: Column, word: str) -> Column:
    """What follows the first ``word``; null without it."""
    pattern = rf"(?i)^.*?\b{word}\b(.*)$"
    return F.when(line.rlike(f"(?i) {word} "), F.trim(F.regexp_extract(line, pattern, 1)))


def left_of(line: Column, word: str) -> Column:
    return F.when(line.rlike(f"(?i) {word} "), F.trim(F.regexp_extract(line, rf"(?i)^(.*?)\b{word}\b.*$", 1)))


def formed(c: Column) -> Column:
    """The first run of words that begin with letters, up to its last company form; null without one.

    Java's matcher calls itself for each round of a repeated group, and a line of thousands of words is too deep for it.  So the text is
    cut where such a run can't go on, and within a piece the words are one repeated class of characters.
    """
    cut = r"(?<=[^A-Za-z0-9&.'\-\s])|(?<=\s)(?=[0-9&.'\-])"
    run = rf"(?i)^[^A-Za-z]*+([A-Z][A-Z0-9&.'\-\s]*\s(?:{COMPANY_FORMS}))\b"
    first = _first(F.transform(F.split(c, cut, -1), lambda x: F.nullif(F.regexp_extract(x, run, 1), F.lit(""))))
    return F.when(c.rlike(rf"(?i)\s(?:{COMPANY_FORMS})\b"), first)


def heading_company(line: Column, title: Column) -> Column:
    """The company of a heading that names a role too; ``title`` is the title that the block's first lines have."""
    bare = trimmed(F.regexp_replace(line, rf"(?i)^(?:work experience|professional experience|employment history|employment|career history|experience|period)\s+", ""))

    def after_title(c: Column) -> Column:
        begins = title.isNotNull() & F.startswith(F.lower(c), F.lower(F.coalesce(title, F.lit(""))))
        return F.when(begins, trimmed(F.substr(c, F.length(title) + 1))).otherwise(c)

    def by_bars(c: Column) -> Column:
        return F.when(c.contains("|"), _first(F.transform(parts_of(c), _part_company)))

    def by_form(c: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(c, r"(?i)^previously worked at\s+", ""), r"(?i)^at\s+", "")
        c = let(c, lambda x: F.coalesce(trimmed(right_of(x, "in")), x))
        return let(trimmed(F.regexp_replace(c, r"\([^)]*\)", "")), lambda x: let(F.struct(x.alias("c"), right_of(x, "in").alias("inner")), named))

    def named(of: Column) -> Column:
        c, inner = of["c"], of["inner"]
        words = F.split(c, " ")
        told = F.when((F.size(words) >= 3) & F.element_at(words, -1).rlike(r"^\p{Lu}"), F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))
        without = F.when(title.isNotNull() & ~c.rlike(HAS_COMPANY) & ~is_company(c), F.lit(None)).otherwise(F.coalesce(F.when(is_company(inner), clean_company(inner)), clean_company(told)))
        return F.when(c == "", F.lit(None)).otherwise(let(formed(c), lambda x: F.when(x.isNotNull(), clean_company(x)).otherwise(without)))

    def of(c: Column) -> Column:
        stops = c.contains("|") & title.isNull() & c.rlike(HAS_ROLE)
        return F.coalesce(by_bars(c), F.when(~stops, let(c, by_form)))

    return F.when(line != "", let(bare, lambda b: let(after_title(b), of)))


def near_company(line: Column, title: Column) -> Column:
    """The company that a line beside a date names: by ``Company - Town, Country``, ``at``, ``in``, bars, as a heading, or alone."""
    left, right = F.trim(F.substring_index(line, " - ", 1)), F.trim(F.regexp_extract(line, r"^.*? - (.*)$", 1))
    known = lambda c: let(c, lambda x: F.when(is_company(x), clean_company(x)))
    reading = F.coalesce(
        F.when(line.contains(" - ") & right.contains(","), known(left)),
        known(right_of(line, "at")),
        known(right_of(line, "in")),
        F.when(line.contains("|"), _first(F.transform(F.reverse(parts_of(line)), _part_company))),
        let(heading_company(line, title), lambda c: F.when(is_company(c), c)),
        known(line),
    )
    return F.when(~line.rlike(r"(?i)\broles?\s*and\s*responsibilit"), reading)


def is_skill(c: Column) -> Column:
    """Whether a text names a skill rather than a role; a single word does."""
    low = F.coalesce(c, F.lit(""))
    return (F.size(F.split(low, " ")) < 2) | (low.rlike(rf"(?i)\b{any_word(SKILL_WORDS)}\b") & ~low.rlike(HAS_ROLE))


def near_role(line: Column, company: Column) -> Column:
    """The role that a line beside a date names: at its begin, before ``at`` or ``in``, between bars, told, or anywhere."""
    good = lambda c: let(c, lambda x: F.when((x != "") & ~is_skill(x), x))
    few = lambda n: F.size(F.split(line, " ")) <= n
    before = lambda word: let(left_of(line, word), lambda c: F.when(c.rlike(HAS_ROLE) & few(12), good(c)))

    def of_part(part: Column) -> Column:
        whole = F.when(part.rlike(HAS_ROLE) & ~is_skill(part) & ~part.rlike(HAS_COMPANY), part)
        return F.when(~part.eqNullSafe(company), F.coalesce(good(title_of(part)), whole))

    reading = F.coalesce(
        good(F.regexp_extract(line, LEADING, 1)),
        before("at"),
        before("in"),
        F.when(line.contains("|"), _first(F.transform(parts_of(line), of_part))),
        good(F.regexp_extract(line, TOLD_ROLE, 1)),
        good(title_of(line)),
        F.when(line.rlike(HAS_ROLE) & ~is_skill(line) & ~line.rlike(HAS_COMPANY) & few(6), line),
    )
    return F.when((line != "") & ~line.rlike(BULLET) & ~line.eqNullSafe(company), reading)


def role_and_company(line: Column) -> Column:
    """(role, company) of ``role - company``, ``company | role``, ``role @ company`` or ``role at company``; null otherwise."""

    def judged(x: Column) -> Column:
        pair = lambda a, b: F.struct(a.alias("role"), F.coalesce(clean_company(b), b).alias("company"))
        l_role, r_role = x["left"].rlike(HAS_ROLE), x["right"].rlike(HAS_ROLE)
        return F.when(l_role & ~r_role & (x["right"] != ""), pair(x["left"], x["right"])).when(r_role & ~l_role & (x["left"] != ""), pair(x["right"], x["left"]))

    def sided(separator: str) -> Column:
        head = F.substring_index(line, separator, 1)
        both = F.struct(trimmed(head).alias("left"), trimmed(F.substr(line, F.length(head) + F.lit(len(separator) + 1))).alias("right"))
        return F.when(line.contains(separator), let(both, judged))

    at = r"(?i)^(.+?)\s+at\s+(.+)$"
    told = F.when(line.rlike(at), F.struct(F.trim(F.regexp_extract(line, at, 1)).alias("role"), clean_company(F.regexp_extract(line, at, 2)).alias("company")))
    return F.coalesce(sided(" - "), sided(" | "), sided(" @ "), told)


def remainder_company(line: Column, role: Column) -> Column:
    """What a first line has after the role it begins with, without a place at its end."""
    rest = trimmed(F.substr(line, F.length(role) + 1))
    rest = trimmed(F.regexp_replace(rest, r"\s+[A-Z][A-Za-z.\s]+,\s*[A-Z][A-Za-z.\s]+$", ""))
    rest = trimmed(F.regexp_replace(rest, rf"\b(?:{TRAILING_PLACES})\b.*$", ""))
    return F.when(role.isNotNull() & F.startswith(F.lower(line), F.lower(F.coalesce(role, F.lit("")))), clean_company(rest))


def sureness(company: Column, role: Column, months: Column) -> Column:
    """0.2, and more for a company, a role, dates and a length."""
    return F.round(F.lit(0.4) + F.when(company.isNotNull(), 0.25).otherwise(0.0) + F.when(role.isNotNull(), 0.25).otherwise(0.0) + F.when(months > 0, 0.1).otherwise(0.0), 2)


def merged_months(found: Column, gap_days: int = 1) -> Column:
    """Months of spans (start, end) together; those that overlap or follow within ``gap_days`` are one.

    A fold over the sorted spans of one row; ``windows.merge_intervals`` does the same over rows.
    """
    start = F.struct(F.lit(0).alias("months"), F.lit(None).cast("date").alias("a"), F.lit(None).cast("date").alias("b"))
    closed = lambda s: s["months"] + F.coalesce(F.when(s["a"].isNotNull(), months_inclusive(s["a"], s["b"])), F.lit(0))

    def add(s: Column, x: Column) -> Column:
        joins = s["b"].isNotNull() & (x["start"] <= F.date_add(s["b"], gap_days))
        return F.struct(
            F.when(joins, s["months"]).otherwise(closed(s)).cast("int").alias("months"),
            F.when(joins, s["a"]).otherwise(x["start"]).alias("a"),
            F.when(joins, F.greatest(s["b"], x["end"])).otherwise(x["end"]).alias("b"),
        )

    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.aggregate(ordered, start, add, lambda s: closed(s).cast("int"))
