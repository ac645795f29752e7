"""Scores of interviews, résumés, ranking and confidence as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .worklines import any_word

# Ranking features and their weights.
WEIGHTS = {"skill_score": 0.4, "experience_score": 0.2, "tfidf_score": 0.2, "bm25_score": 0.1, "education_score": 0.1}
# Words of tasks done, of leading, of working together and of measured effect.
ACTIONS = ("developed", "built", "implemented", "designed", "optimized", "integrated", "created", "deployed", "maintained", "architected")
LEADING = ("led", "managed", "mentored", "supervised", "directed", "headed")
TOGETHER = ("collaborated", "coordinated", "partnered", "team", "stakeholders")
EFFECT = r"\d+\s*%|\b(?:increased|reduced|improved|saved|grew)\b"
# What counts as evidence of backend work.
BACKEND = (
    "api development", "rest api", "restful", "database", "sql", "nosql", "authentication", "authorization",
    "backend", "server", "microservice", "integration", "endpoint", "middleware", "orm", "query optimization",
)
# Keywords of simple and of advanced projects, and their points.
JUNIOR = {"web": 2, "backend": 2, "frontend": 2, "database": 2, "api": 2, "responsive": 1, "crud": 1, "rest": 2}
SENIOR = {
    "microservices": 3, "architecture": 3, "cloud": 3, "aws": 2, "kubernetes": 2,
    "docker": 2, "scalable": 2, "distributed": 2, "ci/cd": 2, "devops": 2,
}
# Degrees of full and of partial relevance, in the order in which they are tried.
HIGH_DEGREES = (
    "computer science", "software engineering", "information technology", "computer engineering", r"\bcs\b",
    "b.tech cs", "b.e cs", "b.tech cse", "mca", "m.tech cs", "bsc cs", "msc cs",
)
SOME_DEGREES = ("engineering", "b.tech", "b.e", "bca", "electronics", "electrical", "bsc it")
BASE_ACTIONS_CAP = 15


def _lower(text: Column, body) -> Column:
    """``body`` of a text in lower case, which is made once a row."""
    return let(F.lower(F.coalesce(text, F.lit(""))), body)


def _some(patterns) -> str:
    """The pattern of any of these, each of which begins with a letter; most places of a text hold none of their first letters."""
    return f"(?=[{''.join(sorted({p.removeprefix(chr(92) + 'b')[0] for p in patterns}))}])(?:{'|'.join(patterns)})"


def to_ten(c: Column) -> Column:
    """A score of 0 to 10 with one decimal, whether given out of 10 or of 100; null stays null."""
    x = c.cast("double")
    scaled = F.least(F.greatest(F.when(x > 10, x / 10).otherwise(x), F.lit(0.0)), F.lit(10.0))
    return F.when(x.isNotNull(), F.round(scaled, 1))  # least and greatest pass over nulls


def interview_score(own: Column, technical: Column, communication: Column, culture: Column) -> Column:
    """Half technical, three tenths communication, two tenths culture where all are there, else the own score."""
    t, c, f = to_ten(technical), to_ten(communication), to_ten(culture)
    weighted = F.round(t * 0.5 + c * 0.3 + f * 0.2, 1)
    return F.when(t.isNotNull() & c.isNotNull() & f.isNotNull(), weighted).otherwise(to_ten(own))


def ranking(features: dict[str, Column]) -> Column:
    """(score, percent): weighted features of 0 to 100, each contribution rounded before they are added."""
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.coalesce(c.cast("double"), F.lit(0.0)) / 100, F.lit(1.0)))
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.round(share(features[name]) * weight, 4)
    score = F.round(total, 4)
    return F.struct(score.alias("score"), F.round(score * 100, 2).alias("percent"))


def clamp_percent(score: Column, most: Column) -> Column:
    """A score as a share of its maximum in percent, 0 to 100 with two decimals; 0 without a maximum."""
    share = F.try_divide(F.coalesce(score.cast("double"), F.lit(0.0)), most.cast("double")) * 100
    return F.when(most > 0, F.round(F.round(F.greatest(F.lit(0.0), F.least(share, F.lit(100.0))), 8), 2)).otherwise(0.0)


def contains_count(text: Column, words) -> Column:
    """How many of the words occur in a lower-case text."""
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def word_count(text: Column, words) -> Column:
    """How often any of the words occurs as a word of a lower-case text."""
    return F.regexp_count(text, F.lit(rf"\b{any_word('|'.join(words))}\b"))


def points(text: Column, keywords: dict[str, int], most: int) -> Column:
    out = F.lit(0)
    for w, p in keywords.items():
        out = out + F.when(text.contains(w), p).otherwise(0)
    return F.least(out, F.lit(most))


def education_score(text: Column) -> Column:
    """10 for a close degree, 6 for a related one, four fifths of it while it is being pursued."""

    def of(t: Column) -> Column:
        base = F.when(t.rlike(_some(HIGH_DEGREES)), 10.0).when(t.rlike(_some(SOME_DEGREES)), 6.0).otherwise(0.0)
        return F.round(base * F.when(t.rlike(_some(("pursuing", "expected", "current", "in progress"))), 0.8).otherwise(1.0), 2)

    return _lower(text, of)


def soft_skills_score(text: Column) -> Column:
    """Up to 2 points for leading, 2 for working together, 1 for measured effects."""
    step = lambda c, two: let(c, lambda n: F.when(n >= two, 2).when(n >= 1, 1).otherwise(0))
    return _lower(text, lambda t: (step(word_count(t, LEADING), 3) + step(word_count(t, TOGETHER), 2) + F.when(F.regexp_count(t, F.lit(EFFECT)) >= 2, 1).otherwise(0)).cast("double"))


def experience_score(text: Column, years: Column, least: Column, most: Column, skills: Column, bonus: Column | None = None) -> Column:
    """Up to 35 points: years against the wanted span, actions and wanted skills in the text, seniority, a title's bonus."""
    y = F.coalesce(years.cast("double"), F.lit(0.0))
    base = F.when(y >= most, 12.0).when(y >= least, 10 + F.try_divide((y - least) * 2, most - least)).otherwise(F.coalesce(F.try_divide(y, least) * 10, F.lit(0.0)))
    more = F.coalesce(bonus, F.lit(0.0)) if bonus is not None else F.lit(0.0)

    def of(t: Column) -> Column:
        named = F.size(F.filter(F.coalesce(skills, F.array().cast("array<string>")), lambda s: t.contains(F.lower(s))))
        actions = F.least(word_count(t, ACTIONS) * 0.5 + named * 1.5, F.lit(float(BASE_ACTIONS_CAP)))
        senior = let(word_count(t, LEADING), lambda leading: F.when((y >= 5) & (leading >= 2), 8).when((y >= 3) & (leading >= 1), 5).when(y >= 2, 3).otherwise(0))
        return F.round(F.least(base + F.when(t == "", 0.0).otherwise(actions + senior + more), F.lit(35.0)), 2)

    return _lower(text, of)


def projects_score(text: Column, years: Column, title: Column) -> Column:
    """Up to 20 points: relevance of the work and, by seniority, complexity of the projects."""
    backend = F.lower(F.coalesce(title, F.lit(""))).rlike("backend|software engineer|api|server|full stack")

    def of(t: Column) -> Column:
        words = F.size(F.split(F.trim(t), r"\s+"))
        counted = F.struct(word_count(t, ACTIONS).alias("actions"), word_count(t, TOGETHER).alias("together"), words.alias("words"))
        return F.when(t == "", 0.0).otherwise(let(counted, lambda n: judged(t, n)))

    def judged(t: Column, n: Column) -> Column:
        density = F.try_divide(n["actions"] * 100.0, n["words"])
        relevance = F.least(F.lit(3.0), n["actions"] * 0.3) + F.when(density > 3, 2).when(density > 2, 1).otherwise(0)
        relevance = relevance + F.when(n["together"] >= 2, 2).when(n["together"] >= 1, 1).otherwise(0)
        relevance = relevance + F.when(t.rlike(_some(("college", "academic", "university project", "course project"))), 0).otherwise(3)
        relevance = relevance + F.when(backend, F.least(contains_count(t, BACKEND), F.lit(3))).otherwise(0)
        complexity = F.when(years <= 3, points(t, JUNIOR, 10)).otherwise(points(t, SENIOR, 10))
        return F.round(F.least(relevance + complexity, F.lit(20.0)), 2)

    return _lower(text, of)


def declared_skills(text: Column) -> Column:
    """Items of the lines between a skills header and the next section's header."""
    section = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?im)^[ \t]*(?:technical\s+)?skills?[ \t]*:?[ \t]*$\n?((?:(?![ \t]*(?:experience|education|projects|work|certifications)).*\n?)*)", 1)
    items = F.split(F.regexp_replace(section, r"(?m)^[-•*][ \t]*", ""), r"[,;|\n]")
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def _doing(t: Column) -> Column:
    """The sentences of a text in lower case that hold a word of tasks done."""
    return F.filter(F.split(t, r"[.!?\n]"), lambda s: s.rlike(_some(ACTIONS)))


def in_action(text: Column, skill: Column) -> Column:
    """Whether a sentence holds the skill and a word of tasks done."""
    return F.exists(_doing(F.lower(text)), lambda s: s.contains(skill))


def skills_score(text: Column, required: Column, projects: Column) -> Column:
    """Up to 30 points: 1 for a declared and 2.5 for a proven skill, 5 more for strong projects; 0 without experience."""
    from ..operators.matching import skill_name

    wanted = F.coalesce(required, F.array().cast("array<string>"))
    known = lambda declared, s: F.exists(declared, lambda d: (skill_name(d) == skill_name(s)) | d.contains(F.lower(s)) | F.lower(s).contains(d))
    told = let(F.transform(declared_skills(text), lambda x: F.lower(x)), lambda own: F.size(F.filter(wanted, lambda s: known(own, s))))

    def of(t: Column) -> Column:
        holds = lambda done, s: F.exists(done, lambda x: x.contains(F.lower(s))) | F.exists(done, lambda x: x.contains(skill_name(s)))
        proven = let(_doing(t), lambda done: F.size(F.filter(wanted, lambda s: holds(done, s))))
        total = told * 1.0 + proven * 2.5 + F.when(projects > 12, 5).otherwise(0)
        fresh = t.rlike(r"\b(?=[fren0])(?:fresher|fresh graduate|recent graduate|entry level|no experience|0\s*\+?\s*years?)\b")
        return F.when(fresh | (t == "") | (F.size(wanted) == 0), 0.0).otherwise(F.round(F.least(total, F.lit(30.0)), 2))

    return _lower(text, of)


def balanced_total(text: Column, years: Column, least: Column, most: Column, skills: Column, title: Column, bonus: Column | None = None) -> Column:
    """(experience, skills, projects, education, soft_skills, total, label, status): the parts and what they say together."""

    def parts_of(projects: Column) -> Column:
        parts = {
            "experience": experience_score(text, years, least, most, skills, bonus),
            "skills": skills_score(text, skills, projects),
            "projects": projects,
            "education": education_score(text),
            "soft_skills": soft_skills_score(text),
        }
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    def judged(p: Column) -> Column:
        total = F.round(p["experience"] + p["skills"] + p["projects"] + p["education"] + p["soft_skills"], 2)
        status = F.when(total >= 55, "shortlisted").when(total >= 45, "review").otherwise("rejected")
        return F.struct(*[p[k].alias(k) for k in ("experience", "skills", "projects", "education", "soft_skills")], total.alias("total"), fit_label(total).alias("label"), status.alias("status"))

    return let(let(projects_score(text, years, title), parts_of), judged)


# The sentences of a summary; {0}, {1}, ... are what is put in.
NO_SUMMARY = (
    "Candidate Summary:\n• Experience Match: Insufficient data for evaluation.\n• Skill Match: Insufficient data for evaluation.\n"
    "• Domain Match: Insufficient data for evaluation.\n• Strengths: Limited structured evidence available.\n"
    "• Gaps (if any): Unable to determine from current data.\n• Overall Fit: Not enough structured information to assess fit."
)
SENTENCES = {
    "no_range": "Candidate shows approximately {0} years of experience; the job requirement is not clearly specified.",
    "at_least": "Candidate experience of {0} years meets or exceeds the minimum requirement of {1}+ years.",
    "too_few": "Candidate experience of {0} years is below the expected minimum of {1}+ years.",
    "in_range": "Candidate experience of {0} years is aligned with the required range of {1}-{2} years.",
    "below": "Candidate experience of {0} years falls below the required range of {1}-{2} years.",
    "above": "Candidate experience of {0} years exceeds the stated range of {1}-{2} years.",
    "skills": "Matched core skills include {0}.",
    "preferred": " Preferred overlap includes {0}.",
    "no_skills": "No strong overlap was found across the listed required skills.",
    "domain": "Relevant domain exposure is visible through experience in {0}.",
    "no_domain": "No clear direct domain match was identified for {0}, based on the structured candidate data.",
    "roles": "Role alignment is supported by prior titles such as {0}.",
    "no_roles": "Domain alignment is not strongly established from the available structured role history.",
    "unclear": "Domain alignment is not clearly established from the available structured data.",
    "strengths": "Key strengths are {0}.",
    "no_strengths": "Key strengths are not strongly evidenced in the current structured comparison.",
    "core": "core skill alignment in {0}",
    "extra": "additional value in {0}",
    "deep": "experience depth appropriate for the role",
    "practical": "relevant practical experience",
    "continuity": "role continuity across {0}",
    "gaps": "Primary gaps include {0}.",
    "no_gaps": "No major gaps are evident from the structured JD comparison.",
    "missing": "missing important skills such as {0}",
    "short": "experience below the stated requirement",
    "no_background": "domain background not clearly available in structured candidate data",
    "strong": "Overall fit appears strong based on required skill coverage and experience alignment.",
    "moderate": "Overall fit appears moderate, with relevant overlap but some notable gaps to assess further.",
    "limited": "Overall fit appears limited due to low alignment on key structured requirements.",
}
BULLETS_OF_SUMMARY = ("Experience Match", "Skill Match", "Domain Match", "Strengths", "Gaps (if any)", "Overall Fit")


def required_years(c: Column) -> Column:
    """(least, most) that a wording asks for: ``a - b`` or ``a to b`` in either order, ``a+``, a single number for both; else nulls."""
    low = F.lower(F.coalesce(c, F.lit("")))
    span, open_, one = r"(\d+(?:\.\d+)?)\s*(?:-|to)\s*(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*\+", r"(\d+(?:\.\d+)?)"
    number = lambda p, k: F.regexp_extract(low, p, k).try_cast("double")
    pair = lambda a, b: F.struct(a.alias("least"), b.alias("most"))
    a, b, none = number(span, 1), number(span, 2), F.lit(None).cast("double")
    return (
        F.when(low.rlike(span), pair(F.least(a, b), F.greatest(a, b)))
        .when(low.rlike(open_), pair(number(open_, 1), none))
        .otherwise(pair(number(one, 1), number(one, 1)))
    )


def title_case(c: Column) -> Column:
    """Every run of letters begins with a capital: ``node.js`` becomes ``Node.Js``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def plain_items(c: Column) -> Column:
    """Lower-case items with single blanks, without blank ones and repeats."""
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def summary(
    required: Column, own: Column, years: Column, asked: Column, preferred: Column | None = None, roles: Column | None = None,
    industries: Column | None = None, title: Column | None = None, industry: Column | None = None,
) -> Column:
    """(experience, skills, domain, strengths, gaps, fit, text): sentences that compare a candidate's fields with a job's.

    ``asked`` has (least, most) years, either may be null.  Of matched skills four are named, of preferred ones three, of others two or three.
    ``text`` is all of them with their headings, or that there is not enough to compare.
    """
    nothing = F.array().cast("array<string>")
    text_of = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c if c is not None else F.lit(""), F.lit("")), r"\s+", " ")))
    items = lambda c: plain_items(c if c is not None else nothing)

    def say(name: str, *what: Column) -> Column:
        parts = re.split(r"\{(\d)\}", SENTENCES[name])
        return F.concat(*[what[int(x)] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x])

    def names(c: Column, n: int) -> Column:
        return F.array_join(F.transform(F.slice(c, 1, n), title_case), ", ")

    def told(f: Column) -> Column:
        y, least, most, hit, miss, extra = f["years"], f["least"], f["most"], f["hit"], f["miss"], f["extra"]
        ys, az, bz = (F.format_string("%.1f", c) for c in (y, least, most))
        some = lambda c: F.size(c) > 0
        experience = (
            F.when(least.isNull() & most.isNull(), say("no_range", ys))
            .when(most.isNull(), F.when(y >= least, say("at_least", ys, az)).otherwise(say("too_few", ys, az)))
            .when(y < least, say("below", ys, az, bz))
            .when(y > most, say("above", ys, az, bz))
            .otherwise(say("in_range", ys, az, bz))
        )
        skills = F.when(some(hit), F.concat(say("skills", names(hit, 4)), F.when(some(extra), say("preferred", names(extra, 3))).otherwise(""))).otherwise(SENTENCES["no_skills"])
        near = lambda own_, asked_: F.filter(own_, lambda x: x.contains(asked_) | asked_.contains(x))
        fields, titles = near(f["industries"], f["industry"]), near(f["roles"], f["title"])
        domain = (
            F.when(f["industry"] != "", F.when(some(fields), say("domain", names(fields, 2))).otherwise(say("no_domain", f["named_industry"])))
            .when((f["title"] != "") & some(f["roles"]), F.when(some(titles), say("roles", names(titles, 2))).otherwise(SENTENCES["no_roles"]))
            .otherwise(SENTENCES["unclear"])
        )
        enough = least.isNotNull() & (y >= least)
        good = F.array_compact(F.array(
            F.when(some(hit), say("core", names(hit, 3))), F.when(some(extra), say("extra", names(extra, 2))),
            F.when(enough, SENTENCES["deep"]).when(y > 0, SENTENCES["practical"]), F.when(some(f["roles"]), say("continuity", names(f["roles"], 2))),
        ))
        bad = F.array_compact(F.array(
            F.when(some(miss), say("missing", names(miss, 4))), F.when(least.isNotNull() & (y < least), SENTENCES["short"]),
            F.when((f["industry"] != "") & ~some(f["industries"]), SENTENCES["no_background"]),
        ))
        share = F.coalesce(F.try_divide(F.size(hit).cast("double"), F.size(f["wanted"])), F.lit(0.0))
        fit = F.when((share >= 0.7) & (least.isNull() | enough), SENTENCES["strong"]).when(share >= 0.4, SENTENCES["moderate"]).otherwise(SENTENCES["limited"])
        listed = lambda c, name: F.when(some(c), say(name, F.array_join(c, ", "))).otherwise(SENTENCES[f"no_{name}"])
        every = F.struct(experience.alias("experience"), skills.alias("skills"), domain.alias("domain"), listed(good, "strengths").alias("strengths"), listed(bad, "gaps").alias("gaps"), fit.alias("fit"))
        blank = ~some(f["wanted"]) & ~some(f["mine"]) & (y == 0) & ~some(f["roles"])
        return let(every, lambda e: F.struct(*[e[k].alias(k) for k in ("experience", "skills", "domain", "strengths", "gaps", "fit")], F.when(blank, NO_SUMMARY).otherwise(_bulleted(e)).alias("text")))

    def fields(i: Column) -> Column:
        return F.struct(
            F.coalesce(years.cast("double"), F.lit(0.0)).alias("years"), asked["least"].alias("least"), asked["most"].alias("most"), *[i[k].alias(k) for k in ("wanted", "mine", "roles", "industries")],
            F.filter(i["wanted"], lambda x: F.array_contains(i["mine"], x)).alias("hit"), F.filter(i["wanted"], lambda x: ~F.array_contains(i["mine"], x)).alias("miss"),
            F.filter(i["liked"], lambda x: F.array_contains(i["mine"], x)).alias("extra"), text_of(title).alias("title"), text_of(industry).alias("industry"),
            (industry if industry is not None else F.lit("")).alias("named_industry"),
        )

    lists = F.struct(items(required).alias("wanted"), items(own).alias("mine"), items(preferred).alias("liked"), items(roles).alias("roles"), items(industries).alias("industries"))
    return let(lists, lambda i: let(fields(i), told))


def _bulleted(e: Column) -> Column:
    keys = ("experience", "skills", "domain", "strengths", "gaps", "fit")
    return F.concat(F.lit("Candidate Summary:"), *[x for head, k in zip(BULLETS_OF_SUMMARY, keys, strict=True) for x in (F.lit(f"\n• {head}: "), e[k])])


# The parts of the final score, each with its weight.
FINAL_WEIGHTS = {"skills": 35.0, "experience": 20.0, "tfidf": 20.0, "bm25": 15.0, "education": 5.0}
#: At most so much with no matched skill and two words of other professions, or one and three.
CAPS = ((0, 2, 35.0), (1, 3, 45.0))
FINAL_LABELS = ((80, "Strong Fit", "shortlisted"), (65, "Potential Fit", "shortlisted"), (50, "Borderline Fit", "review"))


def final_fit(percent: Column, features: Column, matched: Column, wanted: Column, ignored: Column, years: Column, place: Column, has_place: Column, relevance: Column) -> Column:
    """(score, label, status, strengths, gaps) from a ranking in percent and its features.

    ``features`` has skill_percent, experience, tfidf, bm25, education (shares of 100) and combined; ``matched`` of ``wanted`` skills are found, and
    ``ignored`` words of other professions stand in the text; ``place`` is the location's score of 0 to 5.
    """

    def judged(f: Column) -> Column:
        score = f["percent"]
        for most, least, cap in reversed(CAPS):
            score = F.when((wanted > 0) & (matched <= most) & (ignored >= least), F.least(f["percent"], F.lit(cap))).otherwise(score)
        weighted = {k: F.round(f[k] / 100 * weight, 2) for k, weight in FINAL_WEIGHTS.items()}

        def told(x: Column) -> Column:
            skill = f["skills"]
            good = F.array_compact(F.array(
                F.when(skill >= 80, F.concat(F.lit("Excellent skills match: "), matched.cast("string"), F.lit(" of "), wanted.cast("string"), F.lit(" required skills"))).when(skill >= 50, F.concat(F.lit("Good skills match: "), skill.cast("string"), F.lit("%"))),
                F.when(x["experience"] >= 12, F.concat(years.cast("string"), F.lit(" years of relevant experience"))),
                F.when(x["education"] >= 4, F.concat(F.lit("Education: "), relevance)),
                F.when(f["combined"] >= 60, F.concat(F.lit("Strong resume-to-JD similarity: "), f["combined"].cast("string"), F.lit("%"))),
                F.when(place >= 5, "Location aligns with job requirement"),
            ))
            bad = F.array_compact(F.array(
                F.when(skill < 50, F.concat(F.lit("Missing "), (wanted - matched).cast("string"), F.lit(" key skills from requirements"))),
                F.when(x["experience"] < 8, "Experience level appears below the role expectation"),
                F.when(x["education"] < 2.5, "Education background not clearly relevant"),
                F.when(has_place & (place == 0), "Location does not align with job requirement"),
            ))
            label, status = F.lit("Weak Fit"), F.lit("rejected")
            for least, name, state in reversed(FINAL_LABELS):
                label, status = F.when(x["score"] >= least, name).otherwise(label), F.when(x["score"] >= least, state).otherwise(status)
            first = lambda c, none: F.when(F.size(c) > 0, F.slice(c, 1, 5)).otherwise(F.array(F.lit(none)))
            return F.struct(F.round(x["score"], 1).alias("score"), label.alias("label"), status.alias("status"), first(good, "Basic qualifications present").alias("strengths"), first(bad, "No significant gaps identified").alias("gaps"))

        return let(F.struct(score.alias("score"), weighted["experience"].alias("experience"), weighted["education"].alias("education")), told)

    return let(F.struct(percent.alias("percent"), *[features[k].alias(k) for k in (*FINAL_WEIGHTS, "combined")]), judged)


def fit_label(total: Column) -> Column:
    return F.when(total >= 75, "Strong Fit").when(total >= 55, "Potential Fit").when(total >= 45, "Borderline Fit").otherwise("Weak Fit")


def location_score(own: Column, wanted: Column, text: Column | None = None) -> Column:
    """5 where a part of the wanted place is in the own place or the text, 2.5 where none is wanted, else 0."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    job = clean(wanted)
    space = F.trim(F.concat_ws(" ", F.nullif(clean(own), F.lit("")), F.nullif(clean(text), F.lit("")) if text is not None else F.lit(None)))
    parts = F.filter(F.transform(F.split(job, r"[,/|-]"), lambda p: F.trim(p)), lambda p: p != "")
    near = F.exists(parts, lambda p: space.contains(p)) | space.contains(job) | job.contains(space)
    return F.when(job == "", 2.5).when(space == "", 0.0).when(near, 5.0).otherwise(0.0)


def score_floor(score: Column, text: Column) -> Column:
    """40 without an analysis, 45 for a zero on a text of over 100 characters."""
    return F.when(score.isNull(), 40.0).when((score == 0) & (F.length(F.coalesce(text, F.lit(""))) > 100), 45.0).otherwise(score)


def entry_confidence(role: Column, company: Column, start: Column, end: Column, months: Column) -> Column:
    """A fifth for any entry, more for company, role, both dates and a duration."""
    full = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    return F.round(0.2 + part(full(company), 0.25) + part(full(role), 0.25) + part(full(start) & full(end), 0.2) + part(months > 0, 0.1), 2)


# Words of a role.
ROLE_WORDS = (
    "engineer", "developer", "manager", "analyst", "architect", "qa", "automation", "backend",
    "frontend", "tester", "specialist", "consultant", "lead",
)


def field_confidence(name: Column, role: Column, location: Column, years: Column, skills: Column, email: Column) -> Column:
    """Fixed scores of the fields, the fields to show (80 or more) and those to hide (under 60)."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    two = lambda good, some, high, low: F.when(good, high).when(some, low).otherwise(0)
    whole_name = F.trim(name).rlike(r"\S\s+\S") & ~F.lower(name).startswith("unknown")
    scores = {
        "name": two(whole_name, full(name), 85, 40),
        "role": two(F.lower(role).rlike("|".join(ROLE_WORDS)), full(role), 85, 50),
        "location": two(location.contains(","), full(location), 85, 60),
        "experience": two(years > 0, years == 0, 85, 50),
        "skills": F.when(F.size(F.coalesce(skills, F.array().cast("array<string>"))) > 0, 90).otherwise(0),
        "email": F.when(full(email), 100).otherwise(0),
    }
    names = lambda test: F.array_compact(F.array(*[F.when(test(c), k) for k, c in scores.items()]))
    return F.struct(*[c.alias(k) for k, c in scores.items()], names(lambda c: c >= 80).alias("display_fields"), names(lambda c: c < 60).alias("hidden_fields"))


def skill_confidence(skills: Column, entities: Column, from_section: Column) -> Column:
    """0.35 for any skill; more for a section of their own, for skills found as entities, and for three or more."""
    own = F.coalesce(skills, F.array().cast("array<string>"))
    low = F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    hits = F.size(F.filter(own, lambda s: F.array_contains(low, F.lower(F.trim(s)))))
    total = 0.35 + F.when(from_section, 0.35).otherwise(0.0) + F.least(hits * 0.05, F.lit(0.2)) + F.when(F.size(own) >= 3, 0.1).otherwise(0.0)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.round(F.least(total, F.lit(1.0)), 2))


def use_second_layer(first_n: Column, second_n: Column, first_months: Column, second_months: Column, first_current: Column, second_current: Column, first_sure: Column, second_sure: Column) -> Column:
    """Whether the second extraction of work history is taken: by presence, months, a current entry, or more entries as sure."""
    more = (second_n > first_n) & (second_sure >= F.greatest(first_sure - 0.05, F.lit(0.0)))
    return F.when(second_n == 0, False).otherwise((first_n == 0) | (second_months > first_months) | (second_current & ~first_current) | more)
