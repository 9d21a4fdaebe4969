"""Chunkers and tokenisers by name, and readers and writers of tables of text."""

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import chunkers, semantic
from lexigrove.sources import tables

TEXT = "One two three. Four five six. Seven eight nine ten."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "  ")], "doc_id long, text string")


@pytest.mark.parametrize(("name", "settings", "want"), [
    ("fixed_size", {"size": 4, "overlap": 1}, ["One two three. Four", "Four five six. Seven", "Seven eight nine ten."]), ("Fixed-Size ", {"size": 30, "overlap": 0, "tokens": "characters"}, [TEXT[:30], TEXT[30:]]),
    ("fixed_characters", {"size": 20, "overlap": 0}, ["One two three. Four", "five six. Seven eigh", "t nine ten."]), ("recursive", {"size": 6, "overlap": 0}, ["One two three. Four five six.", "Seven eight nine ten."]),
    ("semantic", {"size": 6}, ["One two three. Four five six.", "Seven eight nine ten."]), ("semantic_percentile", {"percentile": 1.0, "encoder": semantic.hash_encoder(8)}, [TEXT]),
])
def test_by_name(docs, name, settings, want):
    got = [r for r in chunkers.chunk(name, docs, **settings).orderBy("doc_id", "chunk_index").collect()]
    blank = [(3, 0, "  ")] if settings.get("tokens") == "characters" else []
    assert [(r["doc_id"], r["chunk_index"], r["content"]) for r in got] == [(1, i, c) for i, c in enumerate(want)] + blank
    assert len({r["chunk_id"] for r in got}) == len(want + blank) and all(r["strategy"] == name for r in got)


def test_settings_and_names_are_checked(docs):
    for call, why in ((lambda: chunkers.chunk("none", docs), "no chunker"), (lambda: chunkers.chunk("fixed_size", docs, width=3), "no setting width"), (lambda: chunkers.chunk("recursive", docs, size=3, overlap=3), "overlap"), (lambda: chunkers.tokenizer("bpe"), "no tokeniser"), (lambda: chunkers.register("Recursive")(len), "there already"), (lambda: chunkers.register_tokenizer("terms", None), "there already")):
        with pytest.raises(ValueError, match=why):
            call()


def test_a_chunker_of_ones_own(docs):
    @chunkers.register("whole")
    def whole(docs, id_col, text_col):
        return docs.where(F.trim(text_col) != "").select(id_col, F.lit(0).alias("chunk_index"), F.col(text_col).alias("content"))

    try:
        assert [r["content"] for r in chunkers.chunk("whole", docs).collect()] == [TEXT]
    finally:
        chunkers._CHUNKERS.pop("whole")


def test_tokenisers(spark):
    df = spark.createDataFrame([(" Ünï  a\tb ",), (None,)], "t string")
    of = lambda name: chunkers.tokenizer(name)
    got = df.select(of("whitespace").count("t"), of("whitespace").first("t", 2), of("whitespace").last("t", 2), of("characters").count("t"), of("terms").last("t", 5)).collect()
    assert [tuple(r) for r in got] == [(3, "Ünï a", "a b", 10, "uni a b"), (0, "", "", 0, "")]


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id, name \n1,"  x, y "\n2,\n', encoding="utf-8")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "id", "name")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("1", "x, y"), ("2", None)]
    with pytest.raises(ValueError, match="missing columns: other"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), "id", "other")
    rows = spark.createDataFrame([(1, None), (2, "é")], "id int, later string")
    for kind in ("json", "csv"):
        tables.write_rows(rows.coalesce(1), f"{tmp_path}/{kind}", kind)
    assert [tuple(r) for r in spark.read.schema("id int, later string").json(f"{tmp_path}/json").orderBy("id").collect()] == [(1, None), (2, "é")]
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/csv", "id", "later").orderBy("id").collect()] == [("1", None), ("2", "é")]


def test_chunk_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"page_content": "a", "metadata": {"chunk_id": "x"}}\n\n{"page_content": "b"}\n')
    assert tables.read_chunk_lines(spark, str(path), 2).count() == 2
    with pytest.raises(ValueError, match="2 chunks, not 3"):
        tables.read_chunk_lines(spark, str(path), 3)
    path.write_text('{"page_content": " "}\n')
    with pytest.raises(Exception, match="blank chunk"):
        tables.read_chunk_lines(spark, str(path)).collect()
    path.write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_chunk_lines(spark, str(path)).collect()
