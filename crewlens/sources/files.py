"""Files as tables: texts, archives, word-processor documents, skill tables, labelled cases."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = (".pdf", ".docx", ".doc", ".txt")
FILE = "path string, name string, content binary"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def archives(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(path, name, content) of the members of ZIP archives that have an allowed extension; folders and hidden files are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)

    def run(batches):
        for batch in batches:
            for where, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for member in archive.infolist():
                        base = member.filename.rpartition("/")[2]
                        if base and not base.startswith(".") and base.lower().endswith(kinds):
                            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([member.filename]), pa.array([archive.read(member)], pa.binary())], ["path", "name", "content"])

    return found.select("path", "content").mapInArrow(run, FILE)


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(path, name, position, text) of the paragraphs, table cells and headers of word-processor files given as (path, name, content)."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(batches):
        from xml.etree import ElementTree

        for batch in batches:
            for row in batch.to_pylist():
                lines = []
                with zipfile.ZipFile(io.BytesIO(row["content"])) as archive:
                    parts = [n for n in archive.namelist() if n.startswith("word/") and n.rpartition("/")[2].startswith(("header", "document")) and n.endswith(".xml")]
                    for part in sorted(parts, key=lambda n: "document" in n):
                        for paragraph in ElementTree.fromstring(archive.read(part)).iter(f"{space}p"):
                            text = "".join(x.text or "" for x in paragraph.iter(f"{space}t")).strip()
                            if text:
                                lines.append(text)
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * n, pa.string()), pa.array([row["name"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(lines, pa.string())],
                    ["path", "name", "position", "text"],
                )

    return files.select("path", "name", "content").mapInArrow(run, "path string, name string, position int, text string")


def first_label(df: DataFrame, *names: str) -> Column:
    """The first of some label columns that a skill table has, trimmed and lower-cased; blank ones are null."""
    own = {c.lower(): c for c in df.columns}
    name = next((own[n.lower()] for n in names if n.lower() in own), None)
    return F.nullif(F.lower(F.trim(F.col(name))), F.lit("")) if name else F.lit(None).cast("string")


def skills(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return table.select(first_label(table, "preferredLabel", "label", "skill", "name").alias("label")).filter("label is not null").distinct()


def synonyms(table: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(alias, label): alternative and hidden labels, one a line; of an alias with several labels the override, else the first."""
    label = first_label(table, "preferredLabel", "label")
    both = F.concat_ws("\n", *[F.col(c) for c in ("altLabels", "hiddenLabels") if c in table.columns])
    rows = table.select(F.explode(F.split(both, "\n")).alias("alias"), label.alias("label")).select(F.lower(F.trim("alias")).alias("alias"), "label", F.lit(1).alias("rank")).filter("alias <> '' and label is not null")
    if overrides is not None:
        rows = rows.unionByName(overrides.select(F.lower(F.trim("alias")).alias("alias"), F.lower(F.trim("label")).alias("label"), F.lit(0).alias("rank")))
    w = W.partitionBy("alias").orderBy("rank", "label")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("alias", "label")


def hierarchy(table: DataFrame, terms: list[str]) -> DataFrame:
    """(parent, child) of neighbouring term columns that are both filled."""
    cells = F.filter(F.array(*[F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in terms]), lambda x: x.isNotNull())
    pairs = F.zip_with(F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0))), F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("parent"), b.alias("child")))
    return table.select(F.explode(pairs).alias("p")).select("p.parent", "p.child").distinct()


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(alias, label) of one JSON object of text by text, in lower case."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "label"))
    return entries.select(F.lower(F.trim("alias")).alias("alias"), F.lower(F.trim("label")).alias("label"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(key, term) of one JSON object of lists by key, in lower case."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "terms"))
    return lists.select(F.lower(F.trim("key")).alias("key"), F.explode("terms").alias("term")).select("key", F.lower(F.trim("term")).alias("term"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a JSON document {"cases": [...]}, one a row."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


def feedback(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines."""
    return spark.read.schema(schema).json(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ranges of a numeric key, so that many tasks share the load."""
    bounds = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()
