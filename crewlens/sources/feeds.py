"""Documents made of job rows: XML feeds, site maps, job-posting JSON, sheets; and the writers of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import json_without_empty, text_or_null
from ..functions.text import salary_range


def escaped(c: Column) -> Column:
    t = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def element(name: str, *inside: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name}>"))


def job_nodes(jobs: DataFrame, fields: dict[str, Column], item: str = "job") -> DataFrame:
    """(id, node): one XML element for each job; writing them as text gives a feed of any size in parts."""
    return jobs.select("id", element(item, *[element(k, escaped(c)) for k, c in fields.items()]).alias("node"))


def site_map(jobs: DataFrame, url: Column) -> DataFrame:
    day = F.date_format(F.coalesce("updated_at", "created_at"), "yyyy-MM-dd")
    return jobs.select("id", element("url", element("loc", escaped(url)), element("lastmod", day)).alias("node"))


def job_posting(jobs: DataFrame) -> DataFrame:
    """(id, posting): a job posting as linked data, without empty fields; the pay has bounds where two amounts are given."""
    s = salary_range(F.col("salary_range"))
    value = F.struct(
        F.lit("QuantitativeValue").alias("@type"),
        F.when(s["high"].isNotNull(), s["low"]).alias("minValue"),
        s["high"].alias("maxValue"),
        F.when(s["high"].isNull(), s["low"]).alias("value"),
        s["unit"].alias("unitText"),
    )
    pay = F.when(s["low"].isNotNull(), F.struct(F.lit("MonetaryAmount").alias("@type"), s["currency"].alias("currency"), value.alias("value")))
    address = F.struct(F.lit("PostalAddress").alias("@type"), text_or_null(F.col("city")).alias("addressLocality"), text_or_null(F.col("country")).alias("addressCountry"))
    return jobs.select("id", json_without_empty(**{
        "@context": F.lit("https://schema.org/"),
        "@type": F.lit("JobPosting"),
        "title": text_or_null(F.col("title")),
        "datePosted": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
        "validThrough": F.date_format("valid_through", "yyyy-MM-dd'T'HH:mm:ss"),
        "hiringOrganization": F.struct(F.lit("Organization").alias("@type"), text_or_null(F.col("company_name")).alias("name")),
        "jobLocation": F.struct(F.lit("Place").alias("@type"), address.alias("address")),
        "baseSalary": pay,
        "directApply": F.lit(True),
    }).alias("posting"))


def sheet(df: DataFrame, longest: dict[str, int]) -> DataFrame:
    """All columns as text, some of them cut, nulls as empty; for ``write_csv``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(*[(F.left(x, F.lit(longest[c])) if c in longest else x).alias(c) for c, x in zip(df.columns, cells, strict=True)])


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Add rows to a table of Parquet or JSON lines."""
    df.write.mode("append").format(kind).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that occur in the frame and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
