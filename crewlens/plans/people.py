"""Queries of names, places and parsed fields of applicants; their SQL knows what was put into the texts, not how it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accuracy, people
from ..sources import resumes as made
from .sql_views import Register

register = Register()


def _gazetteer(spark):
    return spark.createDataFrame(list(made.TOWNS), "spelling string, canonical string")


@register()
def t42_ranked_names(spark, d):
    """The best reading of a name in every applicant's head."""
    return made.applicants(spark, d).select("id", people.best_name(F.col("text")).alias("name"))


@register()
def t43_gazetteer_places(spark, d):
    """The place that every applicant's head names, in canonical form, and what kind of line said so."""
    return people.places(made.applicants(spark, d), "id", "text", _gazetteer(spark))


@register()
def e14_parsed_twice(spark, d):
    """Fields of all applicants, those that were unsure read once more."""
    out = people.parsed(made.applicants(spark, d).select("id", "text"), "id", "text", list(made.SKILLS), _gazetteer(spark))
    return out.withColumns({c: F.array_join(c, ",") for c in ("skills", "retried")})


def _truth(spark, d):
    a = made.applicants(spark, d)
    low = F.array_join(F.transform(F.split("name", " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")
    return a.select("id", low.alias("true_name"), F.col("town").alias("true_location"), F.col("skills").alias("true_skills"), F.size("skills").alias("true_n_skills"))


def _read(spark, d, twice: bool):
    rows = made.applicants(spark, d).select("id", "text")
    if not twice:
        return people.first_pass(rows, "id", "text", list(made.SKILLS))
    return people.parsed(rows, "id", "text", list(made.SKILLS), _gazetteer(spark))


def _benchmark(spark, d, read):
    both = read.withColumn("n_skills", F.size("skills")).join(_truth(spark, d), "id")
    return accuracy.benchmark(both, ["name", "location"], ["n_skills"], ["skills"])


@register()
def a35_parse_benchmark(spark, d):
    """Names, places, skills and their numbers of all applicants, as parsed, against what was put there."""
    return accuracy.readiness(_benchmark(spark, d, _read(spark, d, True)))


@register()
def a36_second_reading_gain(spark, d):
    """What the second reading adds to each measure; the first one, which both benchmarks start from, is done once."""
    first = people.first_reading(made.applicants(spark, d).select("id", "text"), "id", "text", list(made.SKILLS))
    again = people.read_again(first, "id", list(made.SKILLS), _gazetteer(spark))
    return accuracy.compared(_benchmark(spark, d, first), _benchmark(spark, d, again))


@register()
def a37_parse_audit(spark, d):
    """Confidences of the first reading, lengths, and how many fields were read again."""
    first = _read(spark, d, False)
    flags = {f"{x}_again": F.col(f"{x}_confidence") < people.RETRY for x in ("name", "location", "skills")}
    rows = first.withColumns(flags).withColumn("section_length", F.length("section"))
    return accuracy.audited(rows, ["name_confidence", "location_confidence", "skills_confidence", "section_length"], list(flags))
