"""Files, feeds and writers."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from crewlens.operators.joins import resolve_column
from crewlens.sources import feeds, files


def docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{body}</w:document>')
    return out.getvalue()


def test_archives_and_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/cv.docx", docx("Ann", "SQL &amp; Go"))
        z.writestr("x/.hidden.docx", b"")
        z.writestr("x/photo.png", b"")
        z.writestr("n.txt", b"text")
    found = files.archives(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["n.txt", "x/cv.docx"]
    lines = files.docx_paragraphs(found.filter(F.col("name").endswith(".docx")))
    assert [(r.position, r.text) for r in lines.orderBy("position").collect()] == [(0, "Ann"), (1, "SQL & Go")]
    (tmp_path / "n.txt").write_text("a\nb")
    assert files.texts(spark, str(tmp_path / "n.txt")).first().text == "a\nb"


def test_skill_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text('preferredLabel,altLabels,hiddenLabels,t1,t2\nPython ,"py\npython3",,IT,Code\nGo,"py",golang,IT,\n')
    assert sorted(r.label for r in files.skills(spark, str(tmp_path / "s.csv")).collect()) == ["go", "python"]
    table = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "s.csv"))
    own = spark.createDataFrame([("PY", "Python 3")], "alias string, label string")
    assert {r.alias: r.label for r in files.synonyms(table).collect()} == {"py": "go", "python3": "python", "golang": "go"}
    assert {r.alias: r.label for r in files.synonyms(table, own).collect()}["py"] == "python 3"
    assert [tuple(r) for r in files.hierarchy(table, ["t1", "t2"]).collect()] == [("it", "code")]


def test_cases_and_feedback(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"cases": [{"id": "1", "expected": {"name": "A"}}, {"id": "2", "expected": {}}]}))
    assert [r.id for r in files.cases(spark, str(tmp_path / "b.json")).orderBy("id").collect()] == ["1", "2"]
    feeds.append(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "log"), "json")
    feeds.append(spark.createDataFrame([("b", 2)], "k string, n int"), str(tmp_path / "log"), "json")
    assert files.feedback(spark, str(tmp_path / "log"), "k string, n int").count() == 2


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1), ("v", 2)], "user string, n int")
    feeds.replace_partitions(rows, str(tmp_path / "t"), "user")
    feeds.replace_partitions(spark.createDataFrame([("u", 9)], "user string, n int"), str(tmp_path / "t"), "user")
    assert {(r.user, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("u", 9), ("v", 2)}
    feeds.write_csv(feeds.sheet(spark.createDataFrame([(1, 'a "b",\nc'), (2, None)], "i int, t string"), {"t": 5}), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert {(r.i, r.t) for r in back.collect()} == {("1", 'a "b"'), ("2", None)}


def test_escaping(one):
    assert one(feeds.element("a", feeds.escaped(F.lit("<x> & y")))) == "<a>&lt;x&gt; &amp; y</a>"


def test_resolve_column(spark):
    df = spark.createDataFrame([(1,)], "candidateId int")
    assert resolve_column(df, "candidate_id", "candidateid") == "candidateId"
    assert resolve_column(df, "slot_time") is None
