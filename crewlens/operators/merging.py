"""Candidate records of one person as one: which record stays, and field by field what the others add.

A record is a placeholder if its stage is one of an interview and it says little else.  A record of an interview stage goes into the best
one of the same (e-mail or name, job) if one of the two is a placeholder; a placeholder left over goes into the most complete record of
the same (name, day).  A record only goes into one that stays.

Groups are never gathered: the best record of a key and the first value of a field are maxima, which Spark takes before the exchange, so a
key that a third of all records have costs one row a task.

Defined cases: blank keys match nobody; ties go to the smaller id; a field that is blank in all records is null; a stage of another record
counts only where its record is preferred to the one that stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much a stage counts, and how much fields count for being preferred and for being complete.
STAGE_WEIGHTS = {"NO_SHOW": 70, "INTERVIEWED": 60, "INTERVIEW_RESCHEDULED": 50, "INTERVIEW_SCHEDULED": 40, "SELECTED": 30, "REJECTED": 20, "SHORTLISTED": 10, "REVIEW": 5, "RESUME_REJECTED": 0}
PREFERRED = {"email": 5, "job_id": 5, "job_title": 4, "current_role": 3, "skills": 2, "resume_score": 2}
COMPLETE = {"email": 6, "job_id": 6, "job_title": 5, "resume_file_path": 4, "resume_text": 4, "resume_score": 3, "current_role": 3, "current_company": 3, "skills": 2}
INTERVIEW_STAGES = ("INTERVIEW_SCHEDULED", "INTERVIEW_RESCHEDULED", "INTERVIEWED", "NO_SHOW")
PLACEHOLDER = 4


def _filled(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return F.coalesce(F.trim(name) != "", F.lit(False))
    return F.coalesce(F.size(name) > 0, F.lit(False)) if kind == "array" else F.col(name).isNotNull()


def _score(df: DataFrame, weights: dict[str, int]) -> Column:
    """Columns that a table does not have count nothing."""
    return sum((F.when(_filled(df, c), n).otherwise(0) for c, n in weights.items() if c in df.columns), F.lit(0))


def scored(df: DataFrame) -> DataFrame:
    """The records with ``preference``, ``completeness``, ``placeholder`` and the two keys."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in STAGE_WEIGHTS.items() for x in kv])[F.col("stage")], F.lit(0))
    owned = F.coalesce(F.col("stage").isin(*INTERVIEW_STAGES), F.lit(False))
    complete = _score(df, COMPLETE)
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    email, name, job = low("email"), low("name"), F.coalesce(F.col("job_id").cast("string"), F.lit(""))
    key = F.when(owned & (job != ""), F.when(email != "", F.concat_ws(":", F.lit("email"), email, job)).when(name != "", F.concat_ws(":", F.lit("name"), name, job)))
    day = F.to_date(F.coalesce("stage_entered_at", "stage_updated_at", "created_at")).cast("string")
    return df.select(
        "*",
        (weight + _score(df, PREFERRED)).alias("preference"),
        complete.alias("completeness"),
        (owned & (complete <= PLACEHOLDER)).alias("placeholder"),
        key.alias("owned_key"),
        F.when(name != "", F.concat_ws(":", name, day)).alias("day_key"),
    ).withColumn("day_key", F.when(F.coalesce("stage_entered_at", "stage_updated_at", "created_at").isNotNull(), F.col("day_key")))


def targets(records: DataFrame) -> DataFrame:
    """(id, target): of each scored record the one that it goes into, itself if it stays."""
    best = lambda key, order: F.max(F.struct(order.alias("o"), (-F.col("id")).alias("n"), "placeholder")).alias("best")
    owned = records.filter("owned_key is not null").groupBy("owned_key").agg(best("owned_key", F.col("preference") + F.col("completeness")))
    by_day = records.filter("day_key is not null and not placeholder").groupBy("day_key").agg(best("day_key", F.col("completeness")))
    slim = records.select("id", "placeholder", "owned_key", "day_key")
    joined = slim.join(owned.select("owned_key", F.col("best").alias("a")), "owned_key", "left").join(by_day.select("day_key", F.col("best").alias("b")), "day_key", "left")
    first = F.when(F.col("placeholder") | F.col("a.placeholder"), -F.col("a.n"))
    second = F.when(F.col("placeholder"), -F.col("b.n"))
    moved = joined.select("id", F.nullif(first, F.col("id")).alias("first"), F.nullif(second, F.col("id")).alias("second")).select("id", F.coalesce("first", "second").alias("target"))
    going = moved.filter("target is not null")
    stays = moved.filter("target is null").select(F.col("id").alias("target"))
    into = going.join(stays, "target", "left_semi").select("id", F.col("target").alias("into"))
    return moved.join(into, "id", "left").select("id", F.coalesce("into", "id").alias("target"))


def merged(df: DataFrame, fields: Sequence[str], with_stage: Sequence[str] = ()) -> DataFrame:
    """(id, fields, stage, with_stage, merged_ids): one row for each record that stays.

    A field is the staying record's own, else that of the most preferred record merged into it; ``with_stage`` are fields that go with the stage.
    """
    records = scored(df)
    rows = records.join(targets(records), "id").withColumn("own", F.col("id") == F.col("target"))
    rank = (F.col("own"), F.col("preference"), (-F.col("id")).alias("n"))
    value = lambda c: F.max(F.when(_filled(df, c), F.struct(*rank, F.col(c).alias("v"))))["v"].alias(c)
    stage = F.max(F.struct("preference", "own", (-F.col("id")).alias("n"), F.struct("stage", *with_stage).alias("v")))["v"].alias("s")
    out = rows.groupBy("target").agg(*[value(c) for c in fields], stage, (F.count(F.lit(1)) - 1).alias("merged"))
    return out.select(F.col("target").alias("id"), *fields, "s.*", "merged")
