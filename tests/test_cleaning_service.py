"""Duplicates over a document's parts, the cleaning service, and long sections."""

import time

import pytest

from lexigrove.operators import parts, sections

SHAPE = "doc_id string, position int, heading string, level int, heading_path array<string>, paragraphs array<string>, lists array<array<string>>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, code array<struct<content:string,language:string>>, links array<struct<text:string,url:string>>"


def row(doc, position, heading, paragraphs=(), lists=(), tables=(), code=(), links=()):
    return (doc, position, heading, 1, [heading] if heading else [], list(paragraphs), [list(x) for x in lists], list(tables), list(code), list(links))


FACT, LINK, CODE = "Two bridges cross the old river.", ("Town map", "https://maps.example/town"), ("def crossed(x):\n    return x", "python")
REPEATS = [
    row("d", 0, "Bridges", [FACT, FACT, FACT.replace(" ", "   ", 1), "Look at the tide."], [["Take the ferry", "Take the ferry", "Mind the gap"]],
        [(["Line", "Stops"], [["North", "12"], ["North", "12"], ["South", "9"]])], [CODE, CODE], [LINK, LINK]),
    row("d", 1, "Tides", ["Look at the tide.", "Boats leave at noon."]), row("d", 2, "Tides", ["Boats leave at noon."]),
]


def test_duplicates_over_a_document(spark):
    df = spark.createDataFrame(REPEATS, SHAPE)
    removed = parts.drop_repeated_parts(df, "doc_id").selectExpr("sum(removed.paragraphs) p", "sum(removed.list_items) l", "sum(removed.table_rows) t", "sum(removed.code_blocks) c", "sum(removed.links) a").first()
    assert tuple(removed) == (4, 1, 1, 1, 1)
    got = sections.clean(df, "doc_id", ("document duplicates",)).orderBy("position").collect()
    assert [r["heading"] for r in got] == ["Bridges", "Tides"]  # the sixth count: a section left without content
    assert got[0]["paragraphs"] == [FACT, "Look at the tide."] and got[1]["paragraphs"] == ["Boats leave at noon."]
    assert got[0]["lists"] == [["Take the ferry", "Mind the gap"]] and got[0]["tables"][0]["rows"] == [["North", "12"], ["South", "9"]]
    assert [tuple(x) for x in got[0]["code"]] == [CODE] and [tuple(x) for x in got[0]["links"]] == [LINK]
    local = sections.clean(df, "doc_id", ("duplicate",)).orderBy("position").collect()
    assert [len(r["paragraphs"]) for r in local] == [2, 2, 1]


@pytest.mark.parametrize("scope", parts.SCOPES)
def test_scopes(spark, scope):
    rows = [row("a", 0, "x", ["one", "ONE ", "", "", "two"], [["i"], ["I", "j"], ["j"]]), row("a", 1, None, ["one", "three"]), row("b", 0, "x", ["three", "two"], [], [(["h"], [["", ""], ["", ""]])]), row("c", 0, "empty")]
    got = {(r["doc_id"], r["position"]): r for r in parts.drop_repeated_parts(spark.createDataFrame(rows, SHAPE), "doc_id", scope).collect()}
    want = {"section": (["one", "", "", "two"], ["one", "three"], ["three", "two"]), "document": (["one", "", "", "two"], ["three"], ["three", "two"]), "corpus": (["one", "", "", "two"], ["three"], [])}[scope]
    assert (got["a", 0]["paragraphs"], got["a", 1]["paragraphs"], got["b", 0]["paragraphs"]) == want
    assert got["a", 0]["lists"] == [["i"], ["j"]] and got["a", 0]["removed"]["list_items"] == 2
    assert got["b", 0]["tables"][0]["rows"] == [["", ""]] and got["c", 0]["paragraphs"] == []
    with pytest.raises(ValueError, match="scope"):
        parts.marked(spark.createDataFrame(rows, SHAPE), "doc_id", "page")


PIPELINE = [
    row("one", 0, "Harbour–rules", ["“Boats”  wait for the signal…", "Boats wait for\xa0the signal...", "Sound the horn.", "Sound  the horn.", "Edit this page"], [["Watch the lamp", "watch  the lamp", "Print"]], links=[("Harbour map", "https://x.example/a"), ("Feedback", "https://x.example/feedback")]),
    row("one", 1, "Table of contents", ["gone"]), row("one", 2, "Lamps", ["Green means​ go on."]),
    row("two", 0, "Broken", ["this one breaks"]), row("two", 1, "Fine", ["kept out with it"]), row("three", 0, "Whole", ["text"]),
]


@pytest.fixture
def breaking():
    @sections.register_function("breaking")
    def breaks(r):
        if "breaks" in r["paragraphs"][0]:
            raise KeyError("no such thing")
        if r["heading"] == "Wrong":
            return r | {"paragraphs": 5}
        return r

    yield ("unicode", "whitespace", "breaking", "boilerplate", "duplicate")
    sections.unregister("breaking")


def test_service(spark, breaking):
    df = spark.createDataFrame(PIPELINE, SHAPE)
    got = sections.clean_service(df, "doc_id", breaking)
    rows = got.sections.where("doc_id = 'one'").orderBy("position").collect()
    assert [r["heading"] for r in rows] == ["Harbour-rules", "Lamps"]
    assert rows[0]["paragraphs"] == ['"Boats" wait for the signal...', "Boats wait for the signal...", "Sound the horn."]
    assert rows[0]["lists"] == [["Watch the lamp"]] and [x["text"] for x in rows[0]["links"]] == ["Harbour map"]
    assert rows[1]["paragraphs"] == ["Green means go on."]
    told = {r["doc_id"]: r for r in got.results.collect()}
    assert {k: r["ok"] for k, r in told.items()} == {"one": True, "two": False, "three": True}
    assert told["two"]["document"] is None and told["two"]["error"] == "breaking: KeyError: 'no such thing'" and told["one"]["error"] is None
    assert got.totals == {"input_sections": 6, "output_sections": 3, "total_documents": 3, "successful_documents": 2, "failed_documents": 1}
    whole = spark.createDataFrame([r for r in PIPELINE if r[0] != "two"], SHAPE)
    plain = {r["doc_id"]: r for r in sections.report(whole, sections.clean(whole, "doc_id"), "doc_id").collect()}
    for k, r in plain.items():
        assert told[k]["input_sections"] == r["input_sections"] and all(told[k]["document"][c] == r[c] for c in told[k]["document"].asDict())


def test_service_stops(spark, breaking):
    df = spark.createDataFrame([*PIPELINE, row("wrong", 0, "Wrong", ["a"])], SHAPE)
    with pytest.raises(sections.CleaningError, match="document two: breaking: KeyError"):
        sections.clean_service(df, "doc_id", breaking, stop_on_error=True)
    assert {r["doc_id"] for r in sections.clean_service(df, "doc_id", breaking).results.where("not ok").collect()} == {"two", "wrong"}
    with pytest.raises(sections.CleaningError, match="no documents"):
        sections.clean_service(df.where("false"), "doc_id")
    with pytest.raises(Exception, match="document (two|wrong): breaking"):
        sections.clean(df, "doc_id", breaking).collect()


def test_long_sections_take_time_in_proportion(spark):
    many = [f"paragraph {i % 15_000}" for i in range(20_000)]
    df = spark.createDataFrame([row("a", 0, "x", many, [many], links=[(p, "u") for p in many])], SHAPE)
    sections.clean(df.where("false"), "doc_id", ("duplicate",)).collect()
    began = time.time()
    got = sections.clean(df, "doc_id", ("duplicate",)).first()
    assert time.time() - began < 20 and got["paragraphs"] == many[:15_000] and len(got["lists"][0]) == len(got["links"]) == 15_000
