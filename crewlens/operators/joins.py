"""Joins on keys that stand in several columns, links between records, fallbacks between sources, list pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_column(df: DataFrame, *names: str) -> str | None:
    """The first of some spellings of a column that a table has, whatever its case."""
    own = {c.lower(): c for c in df.columns}
    return next((own[n.lower()] for n in names if n.lower() in own), None)


def any_key(left: DataFrame, left_id: str, left_keys: Sequence[Column], right: DataFrame, right_id: str, right_keys: Sequence[Column]) -> DataFrame:
    """(left_id, right_id) of rows that agree in any of their keys: keys become rows, so the join is one of equality."""
    tall = lambda df, i, keys: df.select(i, F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.lower(F.trim(k.cast("string"))), F.lit("")) for k in keys])))).alias("_key"))
    return tall(left, left_id, left_keys).join(tall(right, right_id, right_keys), "_key").select(left_id, right_id).distinct()


def related(records: DataFrame, id_column: str, code: Column) -> DataFrame:
    """(id, other): a record, what its code names, and the records whose codes name it; one step both ways."""
    own = records.select(F.col(id_column).alias("id"), F.lower(F.trim(code)).alias("code"))
    ids = own.select("id", F.lower(F.col("id").cast("string")).alias("key"))
    links = own.join(ids.withColumnRenamed("id", "named"), F.col("code") == F.col("key")).select("id", F.col("named").alias("other"))
    back = links.select(F.col("other").alias("id"), F.col("id").alias("other"))
    return own.select("id", F.col("id").alias("other")).union(links).union(back).distinct()


def first_source(key: str, *sources: DataFrame) -> DataFrame:
    """Rows of the first source, then of the next for keys that none before had."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source.join(out.select(key).distinct(), key, "left_anti"))
    return out


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
