"""Round trips of packed blocks and files, and the query against the tokenizer."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crewlens.llm import queries, token_store
from crewlens.llm.shared import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("width", [0, 1, 7, 16, 31, 32])
def test_pack(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (5, 64)).astype(np.uint32)
    words = token_store.pack(values, width)
    assert words.shape == (5, width)
    assert (token_store.unpack(words, width) == values).all()


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 5000, 2_100_000])
def test_file(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n).astype("<u4")
    ids[rng.random(n) < 0.05] = 49_407
    ids[: n // 3] = 7
    out, at = token_store.FileWriter(), 0
    documents = []
    while at < n:
        size = int(rng.integers(1, 400_000))
        documents.append((None if len(documents) == 1 else -len(documents), len(ids[at : at + size])))
        out.add(documents[-1][0], ids[at : at + size])
        at += size
    content = out.finished() + token_store.MAGIC
    file = token_store.FileReader(content)
    assert (file.ids() == ids).all()
    assert [(None if d["none"] else int(d["doc_id"]), int(d["n"])) for d in file.documents] == documents
    assert (file.blocks(len(file.entries) - 1, len(file.entries)) == ids[(len(file.entries) - 1) * 1024 :]).all()
    if n > 4000:
        assert len(content) < 2 * n  # narrower than the ids, outliers apart
        assert file.entries["odd"].max() > 0
    with pytest.raises(ValueError, match="token file"):
        token_store.FileReader(content[:-1])


def test_files_of_awkward_tables(spark, frame, awkward):
    rows = sorted(awkward, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for some in (rows, [(i, "# 2 #") for i in range(9)] + [(4, None)] * 20):
        for file_ids in (1, 3000, 1 << 24):
            docs = frame(some).coalesce(1)
            folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
            token_store.write_token_store(docs, folder, PATH, file_ids)
            got = [tuple(r) for r in token_store.read_token_store(spark, folder).collect()]
            assert sorted(got, key=lambda r: r[1]) == expected(some)
    local = folder.removeprefix("file:")
    assert all(open(f"{local}/{x}", "rb").read()[-4:] == b"PFR1" for x in os.listdir(local) if x.startswith("part-"))
    assert token_store.token_ids(frame(some).limit(0), PATH).collect() == []


def test_starts_in_three_levels(spark, monkeypatch):
    monkeypatch.setattr(token_store, "NEAR", 3)
    counts = {(t, p): 10 * t + p + 1 for t in range(11) for p in range(1 + t % 3)}
    rows = [(t, p, b"..." + np.array([n, 0, 0], ">u8").tobytes() + b"PFR1") for (t, p), n in counts.items()]
    got = {(r.task, r.part): r["first"] for r in token_store.file_starts(spark.createDataFrame(rows, "task long, part long, content binary")).collect()}
    total = 0
    for key in sorted(counts):
        assert got[key] == total
        total += counts[key]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op12_token_ids(spark, d).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(rows)
