"""Golden cases of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import citations, dialogue
from lexigrove.functions import text as X
from lexigrove.operators import chunking, cleaning, evaluation, manifest, retrieval
from lexigrove.sources import html, tables


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (X.clean_inline, "  Cloud \t  Reliability\r\nguide ", "Cloud Reliability guide"),
        (X.clean_multiline, "a  b \r\n\r\n\r\n\r\n c", "a b\n\nc"),
        (X.clean_code, "\n\n  x = 1  \n\ty\n \n", "  x = 1\n\ty"),
        (X.clean_unicode, "﻿Cloud Reliability​", "Cloud Reliability"),
        (X.clean_unicode, "a\tb…“q”", 'ab..."q"'),
        (X.boilerplate_form, "  Was this page helpful?  ", "was this page helpful"),
        (X.is_boilerplate, "Last updated: 2024-01-01", True),
        (X.is_boilerplate, "Real content", False),
        (X.query_string, "Who shares responsibility for sustainability?", '"shares" OR "responsibility" OR "sustainability"'),
        (X.query_terms, "is it the", ["is", "it", "the"]),
        (X.sentences, "One. Two!  Three?", ["One.", "Two!", "Three?"]),
        (X.paragraphs, "a\nb\n\n \nc", ["a b", "c"]),
        (X.canonical_filename, "docs\\A/B.MD", "b.md"),
        (X.tokens, "  ", []),
    ],
)
def test_text(spark, fn, text, want):
    assert value(spark, text, fn) == want


@pytest.mark.parametrize(
    ("text", "language"), [("What is this?", "en"), ("C'est bien", "fr"), ("le prix de la table", "fr"), ("bonjour", "fr"), ("مرحبا", "ar"), (None, "en")]
)
def test_language(spark, text, language):
    assert value(spark, text, dialogue.language)["language"] == language


@pytest.mark.parametrize(("text", "history", "want"), [("Hello!", True, "GREETING"), ("and why?", True, "FOLLOW_UP"), ("and why?", False, "KNOWLEDGE_QUERY"), ("Explain sharding in depth", True, "KNOWLEDGE_QUERY")])
def test_intent(spark, text, history, want):
    assert value(spark, text, lambda c: dialogue.intent(c, F.lit(history))) == want


def test_citations(spark):
    allowed = F.array(F.lit("[a.md:a.md__chunk_0]"))
    good = value(spark, "yes [source: a.md:a__md__chunk_0]", lambda c: citations.verdict(c, allowed))
    assert good["valid"] and good["outcome"] == "valid"
    assert value(spark, "x [b:1]", lambda c: citations.verdict(c, allowed))["outcome"] == "unauthorized_citation"
    assert value(spark, " ", lambda c: citations.verdict(c, allowed))["outcome"] == "empty_answer"
    assert value(spark, "none", lambda c: citations.verdict(c, allowed))["missing"] == ["[a.md:a.md__chunk_0]"]


def test_token_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(26)))], "doc_id long, text string")
    got = [(r["start"], r["start"] + r["token_count"]) for r in chunking.fixed_tokens(docs, 8, 2).orderBy("chunk_index").collect()]
    assert got == [(0, 8), (6, 14), (12, 20), (18, 26)]


@pytest.mark.parametrize("size", [5, 8, 18])
def test_packed_chunks_stay_within_size(spark, size):
    text = "One two three. " * 9 + "\n\n" + "alpha, beta; gamma " * 11
    for c, _ in chunking.pack(list(chunking.units(text, size)), size, 2):
        assert 0 < len(c.split()) <= size


def test_semantic_breaks():
    assert [w for _, w in chunking.pack(["a b", "a b", "x y"], 10, 0, [False, False, True], 1)] == ["semantic_threshold", "document_end"]


def test_sections():
    page = "<html><body><nav>x</nav><main><h1>T</h1><p>one <a href='u'>l</a></p><h2>S</h2><ul><li>i<li>j</ul><table><tr><th>A<th>B</tr><tr><td>1<td>2</tr></table><pre><code class='language-py'>x=1</code></pre></main>"
    one, two = html.html_sections(page)
    assert (one["heading"], one["paragraphs"], one["links"]) == ("T", ["one l"], [{"text": "l", "url": "u"}])
    assert two["heading_path"] == ["T", "S"] and two["lists"] == [["i", "j"]]
    assert two["tables"] == [{"headers": ["A", "B"], "rows": [["1", "2"]]}] and two["code"] == [{"content": "x=1", "language": "py"}]


def test_markdown():
    found = html.markdown_sections("# T\n\nhello *you* [l](u)\n\n## S\n- a\n- b\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\n```python\nx = 1\n```\n")
    assert [s["heading"] for s in found] == ["T", "S"]
    assert found[1]["lists"] == [["a", "b"]] and found[1]["tables"][0]["rows"] == [["1", "2"]] and found[1]["code"][0]["language"] == "python"


def test_manifest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "document_id string, checksum string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "document_id string, checksum string")
    assert {r["document_id"]: r["status"] for r in manifest.merge(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "missing", "d": "new"}


def test_phrases_and_filters(spark):
    corpus = spark.createDataFrame([(1, "alpha beta gamma", "s", "en"), (2, "beta alpha", "s", "fr"), (3, "delta", "s", "en")], "chunk_id long, content string, source string, lang string")
    ask = spark.createDataFrame([(0, "alpha-beta")], "query_id long, question string")
    assert [r["chunk_id"] for r in retrieval.bm25(corpus, ask).collect()] == [1]
    ask = spark.createDataFrame([(0, "alpha")], "query_id long, question string")
    every = {r["chunk_id"]: r["score"] for r in retrieval.bm25(corpus, ask).collect()}
    some = {r["chunk_id"]: r["score"] for r in retrieval.bm25(corpus, ask, keep=corpus.where("lang = 'en'")).collect()}
    assert set(every) == {1, 2} and some == {1: every[1]}


def test_gate(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.5, None, 0.03, 2), (2, 0.1, 0.0, None, 0.01, 0)], "query_id long, top1_score double, margin double, top1_cosine double, top1_rrf double, supporting long")
    got = {r["query_id"]: (r["accepted"], r["failed_rules"]) for r in evaluation.gate(rows, 0.3, 0.1, None, 0.015, 1).collect()}
    assert got == {1: (True, ""), 2: (False, "top1_score,margin,rrf,supporting_results")}
    assert evaluation.grid(spark).count() == 8400


def test_duplicate_lines(spark):
    docs = spark.createDataFrame([(1, "A b\nx\na  B\n\n\nx")], "doc_id long, text string")
    assert cleaning.join_lines(cleaning.drop_repeats(cleaning.to_lines(docs))).first()["text"] == "A b\nx\n\n"


def test_folder(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    for name in ("a.md", "b.HTML", "c.exe", "skip/d.md"):
        (tmp_path / name).write_text(name)
    files = tables.scan_folder(spark, str(tmp_path), ("md", ".html"), ("skip",))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["a.md", "b.HTML"]
    assert [tuple(r) for r in tables.extension_counts(files).collect()] == [(".html", 1, 6), (".md", 1, 4)]


def test_chunk_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"page_content": "x", "metadata": {"chunk_id": str(i)}}) for i in range(3)))
    assert tables.read_chunk_lines(spark, str(tmp_path / "c.jsonl")).count() == 3
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.require_columns(spark.range(1), "id", "z")
