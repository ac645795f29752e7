"""Runs of marks, on unchanged texts, against a plain version; no document is left out."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from crewlens.functions import text as t
from crewlens.plans import catalogue


def plain(x):
    x = re.sub(r"[^\w\s@.,;:/+#&()'\-|]", " ", x or "")
    x = re.sub(r"(?<!\w)[@#&=~*_]{2,}|[@#&=~*_]{2,}(?!\w)", " ", x)
    return re.sub(r"([.,;:|/()\-])\1+", r"\1", x)


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab1_ @#&=~*'.,-\n|(é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return ["__init__(self)", "a__b", "snake__case ##", "def f(): __x", None, *made]


def test_operator(spark):
    got = spark.createDataFrame(list(enumerate(texts())), "i long, x string").select("i", t.without_special_characters(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: plain(x) for i, x in enumerate(texts())}


def test_every_document_is_a_row(spark, tmp_path):
    spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["t5_without_special_characters"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.cleaned for r in got} == {i: plain(x) for i, x in enumerate(texts())}
