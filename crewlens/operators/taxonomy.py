"""Skills against a dictionary and a hierarchy: closure over parents, what is believed, what is blocked, what is added.

Defined cases: edges with a null end, and loops from a skill to itself, say nothing; repeated edges count once; a cycle makes its members
each other's ancestors and none its own; blank skills go; ties of place are broken by the skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

MOST_SKILLS = 50


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent, steps): every ancestor with the least number of steps, by joining paths with paths until none is new.

    A round doubles the length of paths, so a chain of n edges takes log n rounds.  Each round is a checkpoint in the cluster's
    shared folder: lineage stays short and lost executors cost no round.
    """
    shared_folder(edges.sparkSession)  # where checkpoints go
    named = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).filter("child <> parent").distinct()
    paths, before = named.withColumn("steps", F.lit(1)).checkpoint(), -1
    while (now := paths.count()) != before:
        on = paths.select(F.col("child").alias("parent"), F.col("parent").alias("upper"), F.col("steps").alias("more"))
        longer = paths.join(on, "parent").select("child", F.col("upper").alias("parent"), (F.col("steps") + F.col("more")).alias("steps"))
        both = paths.unionByName(longer).filter("child <> parent")
        paths, before = both.groupBy("child", "parent").agg(F.min("steps").alias("steps")).checkpoint(), now
    return paths


def confidence_label(in_dictionary: Column, is_synonym: Column, in_text: Column, from_section: Column) -> Column:
    """'high' for a dictionary's skill in a section of its own, 'medium' if known otherwise or told in such a section, else 'low'."""
    return F.when(in_dictionary & from_section, "high").when(in_dictionary | is_synonym | (in_text & from_section), "medium").otherwise("low")


def holds(text: Column, skill: Column) -> Column:
    """Whether a text has a skill as a whole word; marks in skills are plain characters."""
    pattern = F.concat(F.lit(r"(?<!\w)\Q"), F.replace(skill, F.lit("\\E"), F.lit("")), F.lit(r"\E(?!\w)"))
    return F.rlike(F.lower(F.coalesce(text, F.lit(""))), pattern)


def finalized(
    skills: DataFrame, key: str, known: DataFrame, hierarchy: DataFrame, blocked: DataFrame, own_blocked: DataFrame, most: int = MOST_SKILLS
) -> DataFrame:
    """(key, place, skill, label, added) of rows (key, place, skill, header, body, from_section).

    A skill stays if ``known`` (skill, synonym) has it, nobody blocks it for all (``blocked``: skill) or for this key (``own_blocked``: key,
    skill), it has two characters, and it does not stand in the header alone.  Then the ancestors of what stays, by ``hierarchy``
    (child, parent, steps), are added in the order of the skills, the nearer ones first; at most ``most`` are kept, each once.
    """
    named = skills.withColumn("skill", F.lower(F.trim("skill"))).filter(F.length("skill") >= 2)
    kept = named.join(known, "skill").join(blocked, "skill", "left_anti").join(own_blocked, [key, "skill"], "left_anti")
    only_header = holds(F.col("header"), F.col("skill")) & ~holds(F.col("body"), F.col("skill"))
    label = confidence_label(~F.col("synonym"), F.col("synonym"), holds(F.col("body"), F.col("skill")), F.col("from_section"))
    own = kept.filter(~only_header).select(key, "place", "skill", label.alias("label"))
    up = own.join(hierarchy.withColumnRenamed("child", "skill"), "skill").select(key, F.struct(F.lit(1).alias("added"), "place", "steps", F.col("parent").alias("name")).alias("rank"), F.col("parent").alias("skill"), F.lit("medium").alias("label"))
    both = own.select(key, F.struct(F.lit(0).alias("added"), "place", F.lit(0).alias("steps"), F.col("skill").alias("name")).alias("rank"), "skill", "label").unionByName(up)
    once = both.groupBy(key, "skill").agg(F.min(F.struct("rank", "label")).alias("r"))
    order = W.partitionBy(key).orderBy("r.rank")
    numbered = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return numbered.select(key, F.col("place").cast("long").alias("place"), "skill", F.col("r.label").alias("label"), (F.col("r.rank.added") == 1).alias("added"))
