"""A plain reading of work histories, one section at a time, by loops over lines; only fixed patterns are shared with the library."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal

from crewlens.functions import history as h
from crewlens.functions import worklines as wl

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
BLANK = r"[\s\x1c-\x1f\x85\u2028\u2029]"


def rx(pattern):
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern).replace(r"\z", r"\Z"), re.ASCII)


def has(pattern, text):
    return text is not None and rx(pattern).search(text) is not None


def group(pattern, text, k=1):
    m = rx(pattern).search(text or "")
    return (m[k] or "") if m else ""


def strip(text, chars=" |-,:"):
    return text.strip(chars)


def work_line(text):
    for dash in "‐‑‒–—―":
        text = text.replace(dash, "-")
    text = text.replace("·", "|")
    for pattern, to in wl.REWRITES:
        text = rx(pattern).sub(lambda m, to=to: re.sub(r"\$(\d)", lambda d: m[int(d[1])] or "", to), text)
    text = re.sub(r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", text).strip(" |-")
    return re.sub(r"^(?:\d{1,2}\)|\d{1,2}\.\s+)", "", text).strip(" ")


def date_of(token, is_end, today):
    c = re.sub(r"\s+", " ", token).strip(" ")
    full = lambda y: int(y) if len(y) >= 4 else int(y) + (2000 if int(y) <= 49 else 1900)
    named = lambda m: MONTHS.index(m[:3].lower()) + 1

    def later(a, b):
        if not b:
            return int(a)
        if len(b) != 2:
            return int(b)
        y = int(a) // 100 * 100 + int(b)
        return y + 100 if y < int(a) else y

    def built(y, m, d=None):
        if not 1 <= y <= 9999 or not 1 <= m <= 12:
            return None
        if d is not None:
            return dt.date(y, m, d) if 1 <= d <= calendar.monthrange(y, m)[1] else None
        return dt.date(y, m, calendar.monthrange(y, m)[1] if is_end else 1)

    edge = 12 if is_end else 1
    forms = (
        (rf"(?i)^{wl.STILL}$", lambda m: today),
        (r"^(\d{4})\.(\d{1,2})$", lambda m: built(int(m[1]), int(m[2]))),
        (rf"(?i)^({wl.MONTH})[\s'’.\-/,]*(\d{{4}}|\d{{2}})$", lambda m: built(full(m[2]), named(m[1]))),
        (r"^(\d{1,2})[/.-](\d{2,4})$", lambda m: built(full(m[2]), int(m[1]))),
        (r"^(\d{4})[./-](\d{1,2})$", lambda m: built(int(m[1]), int(m[2]))),
        (r"(?i)^(?:FY|AY)\s*[- ]?(\d{4})(?:\s*[-/]\s*(\d{2,4}))?$", lambda m: built(later(m[1], m[2]) if is_end else int(m[1]), edge)),
        (r"^(\d{4})\s*[-/]\s*(\d{2,4})$", lambda m: built(later(m[1], m[2]) if is_end else int(m[1]), edge)),
        (r"^(\d{4})$", lambda m: built(int(m[1]), edge)),
        (rf"(?i)^(\d{{1,2}})[.\-/\s]({wl.MONTH})[.\-/\s,'’]+(\d{{2,4}})$", lambda m: built(full(m[3]), named(m[2]), int(m[1]))),
        (rf"(?i)^({wl.MONTH})[.\-/\s,'’]+(\d{{1,2}})(?:st|nd|rd|th)?[,\s.\-/]+(\d{{2,4}})$", lambda m: built(full(m[3]), named(m[1]), int(m[2]))),
        (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", lambda m: built(int(m[3]), int(m[2]), int(m[1]))),
    )
    for pattern, of in forms:
        m = rx(pattern).search(c)
        if m and (found := of(m)) is not None:
            return found
    return None


def held(a, b, today):
    return a is not None and b is not None and a <= b and a <= today and (b.year, b.month) <= (today.year, today.month)


def span(a, b, today):
    s, e = date_of(a, False, today), date_of(b, True, today)
    return (s, e, has(rf"(?i)^{wl.STILL}$", b)) if held(s, e, today) else None


def spans(line, today):
    return [s for m in rx(wl.RANGE).finditer(line) if (s := span(m[1], m[2], today))]


def wider(line, today):
    found = [span(m[1], m[2], today) for m in rx(wl.WIDER).finditer(line)]
    found += [span(m[1], m[2] or "Present", today) for m in rx(wl.SENTENCE).finditer(line)]
    if has(r"(?i)^(?:(?:FY|AY)\s*[- ]?\d{4}(?:\s*[-/]\s*\d{2,4})?|\d{4}\s*[-/]\s*\d{2,4})$", line):
        found.append(span(line, line, today))
    return list(dict.fromkeys(s for s in found if s))


def is_company(c):
    if not c or has(rf"(?i)\b(?:{wl.ACTION_WORDS})\b", c) or has(wl.HAS_ROLE, c) or "," in c or has(rf"(?i)\b(?:{wl.NO_COMPANY_WORDS})\b", c):
        return False
    words = c.split(" ")
    return has(wl.HAS_COMPANY, c) or (len(words) >= 2 and not any(w[:1].islower() for w in words))


def clean(c):
    if c is None:
        return None
    c = rx(r"(?i)^(?:worked|working|joined|serving)\s+").sub("", c)
    c = rx(r"(?i)\b(?:at|with|for)\b\s+").sub("", c)
    if title := group(wl.TITLE, c):
        c = c.replace(title, " ")
    c = rx(r"(?i)\(\s*(?:\d{4}\s*(?:-|to)\s*(?:\d{4}|now|present)|digital agency)?\s*\)").sub("", c)
    c = rx(r"\s*-\s*[A-Z][A-Za-z.\s]+,\s*[A-Z][A-Za-z.\s]+$").sub("", c)
    for place in wl.PLACES:
        c = rx(rf"(?i)\b{place}\b").sub("", c)
    return strip(rx(r"\s+").sub(" ", c)) or None


def part_company(part):
    c = strip(rx(wl.PLACE_TAIL).sub("", part))
    return clean(c) if is_company(c) or (has(wl.NAME, c) and not has(wl.HAS_ROLE, c)) else None


def sides(line, word):
    if f" {word} " not in line.lower():
        return None, None
    left, right = rx(rf"(?i)\b{word}\b").split(line, maxsplit=1)
    return left.strip(" "), right.strip(" ")


def parts_of(line):
    return [p.strip(" ") for p in line.split("|") if p.strip(" ")]


def heading(line, title):
    if not line:
        return None
    c = strip(rx(r"(?i)^(?:work experience|professional experience|employment history|employment|career history|experience|period)\s+").sub("", line))
    if title and c.lower().startswith(title.lower()):
        c = strip(c[len(title) :])
    if "|" in c:
        for p in parts_of(c):
            if found := part_company(p):
                return found
        if title is None and has(wl.HAS_ROLE, c):
            return None
    c = rx(r"(?i)^at\s+").sub("", rx(r"(?i)^previously worked at\s+").sub("", c))
    if sides(c, "in")[1] is not None:
        c = strip(sides(c, "in")[1])
    c = strip(rx(r"\([^)]*\)").sub("", c))
    if not c:
        return None
    if named := group(rf"(?i)([A-Z][A-Za-z0-9&.'-]*(?:\s+[A-Z][A-Za-z0-9&.'-]*)*\s+(?:{wl.COMPANY_FORMS}))\b", c):
        return clean(named)
    if title and not has(wl.HAS_COMPANY, c) and not is_company(c):
        return None
    inner = sides(c, "in")[1]
    if inner is not None and is_company(inner) and clean(inner):
        return clean(inner)
    words = c.split(" ")
    return clean(" ".join(words[:-1])) if len(words) >= 3 and words[-1][:1].isupper() else None


def near_company(line, title):
    if not line or has(r"(?i)\broles?\s*and\s*responsibilit", line):
        return None
    tries = []
    if " - " in line and "," in line.split(" - ", 1)[1] and is_company(line.split(" - ", 1)[0].strip(" ")):
        tries.append(clean(line.split(" - ", 1)[0].strip(" ")))
    for word in ("at", "in"):
        right = sides(line, word)[1]
        if right is not None and is_company(right):
            tries.append(clean(right))
    if "|" in line:
        tries += [part_company(p) for p in reversed(parts_of(line))]
    found = heading(line, title)
    if is_company(found):
        tries.append(found)
    if is_company(line):
        tries.append(clean(line))
    return next((x for x in tries if x), None)


def is_skill(c):
    low = (c or "").lower()
    return len(low.split(" ")) < 2 or (has(rf"(?i)\b(?:{wl.SKILL_WORDS})\b", low) and not has(wl.HAS_ROLE, low))


def near_role(line, company):
    if not line or has(wl.BULLET, line) or line == company:
        return None
    good = lambda c: c if c and not is_skill(c) else None
    few = len(line.split(" "))
    tries = [good(group(wl.LEADING, line))]
    for word in ("at", "in"):
        left = sides(line, word)[0]
        tries.append(good(left) if left is not None and has(wl.HAS_ROLE, left) and few <= 12 else None)
    if "|" in line:
        for p in parts_of(line):
            if p != company:
                tries.append(good(group(wl.TITLE, p)) or (p if has(wl.HAS_ROLE, p) and not is_skill(p) and not has(wl.HAS_COMPANY, p) else None))
    tries += [good(group(wl.TOLD_ROLE, line)), good(group(wl.TITLE, line))]
    tries.append(line if has(wl.HAS_ROLE, line) and not is_skill(line) and not has(wl.HAS_COMPANY, line) and few <= 6 else None)
    return next((x for x in tries if x), None)


def without_dates(line):
    return strip(rx(wl.RANGE).sub("", line))


def read(lines):
    """Company and role of a group of lines."""
    bare = [without_dates(x) for x in lines]
    title = next((t for b in bare[:3] if (t := group(wl.TITLE, b))), None)
    at = next((k for k, x in enumerate(lines) if has(wl.RANGE, x)), 0)
    beside = [(0, bare[at])] + [(k - at, lines[k]) for k in [*range(max(0, at - 2), at), *range(at + 1, min(len(lines), at + 3))] if not has(rf"(?i)^(?:{wl.SECTION_NAMES})\Z", lines[k])]
    near = [x.replace("?", "|") for _, x in beside if x]
    label = lambda name, x: group(rf"(?i)^{name}\s*:\s*(.+)$", x).strip(" ") or None
    company = next((c for x in lines[:4] if (c := clean(label("organization", x)))), None)
    company = company or next((c for b in bare[:3] if is_company(c := heading(b, title))), None)
    company = company or next((c for x in near if (c := near_company(x, title))), None)
    role = next((r for x in lines[:4] if not is_skill(r := label("designation", x))), None)
    role = role or next((r for x in near if (r := near_role(x, company))), None)
    return company, role, bare


def months(a, b):
    return max((b.year - a.year) * 12 + b.month - a.month + (b.day >= a.day), 1)


def entry(company, role, s, text=""):
    start, end = s[0].replace(day=1), s[1].replace(day=calendar.monthrange(s[1].year, s[1].month)[1])
    sure = Decimal("0.5") + (Decimal("0.25") if company is not None else 0) + (Decimal("0.25") if role is not None else 0)
    return {"company": company, "role": role, "start": start, "end": end, "current": s[2], "months": months(start, end), "confidence": float(sure)}


def blocks(content, today):
    lines = [work_line(x) for x in re.split(r"\r\n?|\n", content or "")]
    dated = [bool(spans(x, today)) for x in lines]
    out, current, seen = [], [], False

    def flush():
        nonlocal current, seen
        if current and seen:
            out.append(current)
        current, seen = [], False

    for k, x in enumerate(lines):
        if not x:
            flush()
            continue
        following = next((dated[j] for j in range(k + 1, len(lines)) if lines[j]), False)
        opens = len(x.split(" ")) <= 12 and not x.endswith(".") and has(wl.HAS_ROLE, x) and following
        if seen and (dated[k] or has(r"(?i)^organization\s*:\s*.+\Z", x)):
            flush()
        if current and not dated[k] and opens:
            flush()
        current.append(x)
        seen = seen or dated[k]
    flush()
    return out


def block_entries(content, today):
    out = []
    for lines in blocks(content, today):
        company, role, bare = read(lines)
        if any(has(wl.BULLET, x) for x in lines[:2]):
            continue
        if not any(has(wl.HAS_ROLE, b) or has(wl.HAS_COMPANY, b) or has(r"(?i) at | in |\|", b) for b in bare[:3]):
            continue
        if not company and role and lines[0].lower().startswith(role.lower()):
            rest = strip(lines[0][len(role) :])
            rest = strip(rx(r"\s+[A-Z][A-Za-z.\s]+,\s*[A-Z][A-Za-z.\s]+$").sub("", rest))
            company = clean(strip(rx(rf"\b(?:{wl.TRAILING_PLACES})\b.*$").sub("", rest)))
        if not company:
            continue
        role = None if is_skill(role) else role
        if has(rf"(?i)\b(?:{wl.CERTIFICATE_WORDS})\b", role) or has(rf"(?i)\b(?:{wl.CERTIFICATE_WORDS})\b", company):
            continue
        out.append(entry(company, role, next(s for x in lines for s in spans(x, today))))
    return out


def pair(line):
    for mark in (" - ", " | ", " @ "):
        if mark in line:
            left, right = (strip(x) for x in line.split(mark, 1))
            if has(wl.HAS_ROLE, left) and right and not has(wl.HAS_ROLE, right):
                return left, clean(right) or right
            if has(wl.HAS_ROLE, right) and left and not has(wl.HAS_ROLE, left):
                return right, clean(left) or left
    if m := rx(r"(?i)^(.+?)\s+at\s+(.+)$").search(line):
        return m[1].strip(" "), clean(m[2])
    return None


def line_entries(content, today):
    lines = [x for x in map(work_line, re.split(r"\r\n?|\n", content or "")) if x]
    out = []
    for k, x in enumerate(lines):
        found = wider(x, today)
        speaks = has(wl.HAS_ROLE, x) or has(wl.HAS_COMPANY, x) or has(r"(?i) \| | at | in |^(?:organization|designation)\s*:\s*.", x)
        if not found and speaks and k + 1 < len(lines):
            found = wider(f"{x} {lines[k + 1]}", today)
        around = [y for y in lines[max(0, k - 1) : k + 3] if not has(rf"(?i)^(?:{wl.OTHER_SECTIONS})\Z", y)]
        if not found or not around:
            continue
        company, role, bare = read(around)
        guess = next((g for b in bare[:3] if b and (g := pair(b))), (None, None))
        role, company = role or guess[0], company or guess[1]
        if role and not company and (split := pair(role)):
            role, company = split
        if company and has(wl.DATE_LIKE, company):
            company = None
        out += [entry(company, role, s) for s in found]
    return distinct(out)


def distinct(entries):
    key = lambda c: rx(rf"(?i)\b(?:{h.COMPANY_NOISE})\b").sub("", c or "").strip(" ").lower()
    by_role: dict = {}
    for k, e in enumerate(entries):
        by_role.setdefault((e["role"], e["start"], e["end"]), []).append((not e["current"], e["company"] is None, -len(e["company"] or ""), k))
    left = sorted(min(v)[3] for v in by_role.values())
    by_company: dict = {}
    for k in left:
        e = entries[k]
        by_company.setdefault((key(e["company"]), e["start"], e["end"]), []).append((-len((e["role"] or "").split(" ")), k))
    return [entries[k] for k in sorted(min(v)[1] for v in by_company.values())]


def merged(found):
    """Months of date intervals, those that overlap or follow on the next day joined."""
    total, a, b = 0, None, None
    for s, e in sorted(found):
        if b is not None and s <= b + dt.timedelta(days=1):
            b = max(b, e)
            continue
        total += months(a, b) if b else 0
        a, b = s, e
    return total + (months(a, b) if b else 0)


def two_places(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))
