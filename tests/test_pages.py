"""Queries over parsed pages and texts, row by row on pages that have tables, links, code and lists; and folded forms."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.plans import content

PAGES = [
    (1, "https://a.example/guide/Start.html", """<html lang="en"><head><title>T</title></head><body><main><h1>Guide</h1><p>One  two</p><ul><li>x</li><li>y</li></ul>
<h2>Numbers</h2><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></tbody></table>
<p>see <a href="u">link</a> <a href="https://x.y/feedback">f</a> <a href="u">link</a></p><h3>Deep</h3><pre><code class="language-py">a = 1</code></pre></main></body></html>"""),
    (2, "https://a.example/b", "<p>Only a paragraph</p><p>Only a paragraph</p><table><tr><td>c</td></tr></table>"), (3, "https://a.example/c", None), (4, "https://a.example/d", ""),
]
DOCS = [(1, "# Top\n\nPara one\ngoes on\n\n- a\n- b\n\n## Next\n\n| H | I |\n|---|---|\n| 1 | 2 |\n\n```py\ncode  x\n```\n", "en", "s", 1), (2, "Plain (c) text. More of it.", "en", "s", 1), (3, None, "en", "s", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def rows(spark, folder, name):
    df = content.QUERIES[name](spark, folder)
    return sorted((tuple(r) for r in df.collect()), key=repr), df.columns


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def test_sections_tables_links(spark, folder):
    got, _ = rows(spark, folder, "html_sections")
    want = [
        (1, 0, "Guide", 1, 1, md5("Guide\n\nOne  two\n\n- x\n- y")), (1, 1, "Numbers", 2, 1, md5("Numbers\n\nsee link f link\n\nA | B\n1 | 2\n3 | 4")), (1, 2, "Deep", 3, 0, md5("Deep\n\n```py\na = 1\n```")),
        (2, 0, None, None, 2, md5("Only a paragraph\n\nOnly a paragraph\n\nc")),
    ]
    assert got == want
    assert rows(spark, folder, "html_tables")[0] == [(1, 1, "A,B", 2), (2, 0, "", 1)]
    assert rows(spark, folder, "html_links")[0] == [(1, 1, "f", "https://x.y/feedback", True), (1, 1, "link", "u", False)]


def test_cleaned_sections_report_blocks_and_chunks(spark, folder):
    got, columns = rows(spark, folder, "clean_sections")
    assert [dict(zip(columns, r)) | {"digest": None} for r in got] == [
        {"page_id": 1, "position": 0, "heading": "Guide", "paragraphs": 1, "links": 0, "digest": None}, {"page_id": 1, "position": 1, "heading": "Numbers", "paragraphs": 1, "links": 1, "digest": None},
        {"page_id": 1, "position": 2, "heading": "Deep", "paragraphs": 0, "links": 0, "digest": None}, {"page_id": 2, "position": 0, "heading": None, "paragraphs": 1, "links": 0, "digest": None},
    ]
    told, columns = rows(spark, folder, "section_report")
    assert [dict(zip(columns, r)) for r in told] == [
        {"page_id": 1, "input_sections": 3, "output_sections": 3, "removed_sections": 0, "removed_paragraphs": 0, "removed_list_items": 0, "removed_table_rows": 0, "removed_code_blocks": 0, "removed_links": 1, "success": True},
        {"page_id": 2, "input_sections": 1, "output_sections": 1, "removed_sections": 0, "removed_paragraphs": 1, "removed_list_items": 0, "removed_table_rows": 0, "removed_code_blocks": 0, "removed_links": 0, "success": True},
    ]
    kinds = [r[:3] for r in rows(spark, folder, "page_blocks")[0]]
    assert kinds == [(1, 0, "heading"), (1, 1, "paragraph"), (1, 2, "list"), (1, 3, "heading"), (1, 4, "paragraph"), (1, 5, "table"), (1, 6, "heading"), (1, 7, "code"), (2, 0, "paragraph"), (2, 1, "table")]
    chunks, columns = rows(spark, folder, "page_chunks")
    assert [(r[0], r[1], r[2], r[4]) for r in chunks] == [(1, 0, 0, 8), (2, 0, 0, 2)]


def test_markdown_and_lines(spark, folder):
    got, _ = rows(spark, folder, "markdown_sections")
    assert [r[:4] for r in got] == [(1, 0, "Top", 1), (1, 1, "Next", 0), (2, 0, None, 1)]
    forms = dict(rows(spark, folder, "evaluation_forms")[0])
    assert forms[2] == md5("plain (c) text. more of it.") and forms[3] == md5("")
    assert dict(rows(spark, folder, "clean_unicode")[0])[2] == md5("Plain (c) text. More of it.")
    assert dict(rows(spark, folder, "clean_code_lines")[0])[3] == md5("")


def test_recursive_chunks(spark, folder):
    got, columns = rows(spark, folder, "chunk_recursive")
    whole = " ".join(DOCS[0][1].split())
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 0, "document_end"), (2, 0, "document_end")] and got[0][2] == len(whole.split())


def test_folded_forms(spark):
    """Compatibility folding comes before all else, in evaluation and in questions."""
    texts = ["ＡＢＣ－１２３", "ﬁne “x” – y", "½ cup²", "plain", None, "été œuvre", "a  b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", X.evaluation_form("t").alias("f")).collect())
    assert got == {0: "abc-123", 1: 'fine "x" - y', 2: "1⁄2 cup2", 3: "plain", 4: "", 5: "été œuvre", 6: "a b"}
    asked = dict(df.select("i", F.array_join(X.query_terms(F.col("t")), " ").alias("q")).collect())
    assert (asked[0], asked[1]) == ("abc-123", "fine")


def test_navigation_of_ones_own(spark):
    df = spark.createDataFrame([(t,) for t in ("Edit", "  my  FOOTER :", "page 12 of 30", "page 12 of 30 words", "text")], "t string")
    got = [r[0] for r in df.where(~X.is_boilerplate("t", ("My footer!",), (r"page \d+ of \d+",))).collect()]
    assert got == ["page 12 of 30 words", "text"]
    urls = spark.createDataFrame([("https://a/privacy",), ("https://a/Login",), ("https://a/b",)], "u string")
    assert [r[0] for r in urls.where(~X.is_boilerplate_url("u", ("/login",))).collect()] == ["https://a/b"]


def test_metadata_of_pages(spark):
    page = """<html lang='fr'><head><title> T </title><meta name="author" content="A. B"><meta name='keywords' content="x, y ,,z"></head></html>"""
    got = [tuple(r) for r in content.H.metadata(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("page_id").collect()]
    assert got == [(1, "fr", "T", None, None, "A. B", ["x", "y", "z"]), (2, None, None, None, None, None, [])]
