"""Sections from parser to chunks: cleaners, report, typed blocks, and windows that know their blocks."""

import pytest

from lexigrove.operators import blocks, sections
from lexigrove.sources import html

PAGE = """<html><body><main><h1>Guide</h1><p>One  two</p><p>one TWO</p><p>Edit this page</p><ul><li>x<li>X<li>y</ul>
<h2>Feedback</h2><p>gone with its heading</p><h2>Part</h2><table><tr><th>A<th>B</tr><tr><td>1<td>2</tr><tr><td>1<td>2</tr></table>
<pre><code>a = 1

</code></pre><p>see <a href='u'>l</a> <a href='https://x.y/feedback'>f</a></p><h2>Part</h2><table><tr><th>A<th>B</tr><tr><td>1<td>2</tr></table>
<pre><code>a = 1</code></pre><p>see l f</p><h2>Bare</h2></main></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    return html.sections(spark.createDataFrame([(1, PAGE), (2, "<p>Print</p>")], "page_id long, html string"), "page_id", "html").cache()


def test_pipeline(parsed):
    got = sections.clean(parsed, "page_id")
    rows = got.orderBy("position").collect()
    assert [(r["page_id"], r["position"], r["heading"]) for r in rows] == [(1, 0, "Guide"), (1, 1, "Part")]
    assert rows[0]["paragraphs"] == ["One two"] and rows[0]["lists"] == [["x", "y"]]
    assert rows[1]["tables"][0]["rows"] == [["1", "2"]] and rows[1]["code"][0]["content"] == "a = 1" and [x["url"] for x in rows[1]["links"]] == ["u"]
    told = {r["page_id"]: r.asDict() for r in sections.report(parsed, got, "page_id").collect()}
    assert told[1] == {"page_id": 1, "input_sections": 5, "output_sections": 2, "removed_sections": 3, "removed_paragraphs": 4, "removed_list_items": 1, "removed_table_rows": 2, "removed_code_blocks": 1, "removed_links": 1, "success": True}
    assert told[2]["success"] is False and told[2]["removed_paragraphs"] == 1
    assert parsed.count() == 6  # the input is as it was


def test_names(parsed):
    assert sections.normal_name(" Duplicate-Cleaner ") == "duplicate"
    with pytest.raises(ValueError, match="no cleaner"):
        sections.clean(parsed, "page_id", ("nothing",))
    with pytest.raises(ValueError, match="already"):
        sections.register("unicode")(lambda df, c: df)


def test_unicode(spark):
    page = "<main><h1>Cloud Reliability​</h1><p>a…“q”</p><pre>x\tb  \n\ty​</pre></main>"
    row = sections.clean(html.sections(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html"), "page_id", ("unicode",)).first()
    assert (row["heading"], row["paragraphs"], row["code"][0]["content"]) == ("Cloud Reliability", ['a..."q"'], "x\tb\n\ty")


def test_blocks_and_chunks(parsed):
    made = blocks.build_blocks(sections.clean(parsed, "page_id"), "page_id").cache()
    rows = made.orderBy("block_index").collect()
    assert [r["block_type"] for r in rows] == ["heading", "paragraph", "list", "heading", "paragraph", "table", "code"]
    assert [r["block_index"] for r in rows] == list(range(7)) and len({r["block_id"] for r in rows}) == 7
    chunks = blocks.chunk_blocks(made, "page_id", 8, 2).orderBy("chunk_index").collect()
    words = " ".join(r["text"] for r in rows).split()
    assert [c["content"] for c in chunks] == [" ".join(words[i : i + 8]) for i in range(0, len(words) - 2, 6)]
    assert chunks[0]["section_id"] is None and chunks[0]["heading_path"] == ["Guide"] and chunks[0]["headings"] == ["Guide", "Part"]
    assert chunks[-1]["section_id"] == "1:1" and chunks[-1]["heading_path"] == ["Guide", "Part"]
    assert chunks[0]["block_ids"] == [r["block_id"] for r in rows[: len(chunks[0]["block_ids"])]]
    with pytest.raises(ValueError, match="overlap"):
        blocks.chunk_blocks(made, "page_id", 8, 8)
