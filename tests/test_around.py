"""Spelling, prompts, runs, sources and rows of an index on small fixtures."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import evaluation, prompts, runs, spelling
from lexigrove.sources import intake, tables


def test_spelling_of_domain():
    want = {"aks": "AKS", "akc": "AKS", "kubernete": "Kubernetes", "kubrnetes": "Kubernetes", "azur": "Azure", "containrs": "containers", "qqqqqqqqqqqq": None, "is": "Advisor", "x" * 9000: None}
    assert {w: spelling.domain_form(w) for w in want} == want
    assert spelling.likeness("abc", "abc") == 100 and spelling.likeness("abc", "xyz") == 0
    assert spelling.part_likeness("cosmosdatabase", "cosmos") == pytest.approx(90)


def test_spelling_of_questions(spark):
    known = spark.createDataFrame([("what", 9), ("my", 9), ("that", 3), ("thing", 5), ("things", 7), ("king", 1)], "word string, n long")
    rows = [(1, "Waht my ( AKc )  thng ?"), (2, "KUBERNETS 42 THIGNS!"), (3, None), (4, "  "), (5, "zzzzzzzzzz my"), (6, "Waht my ( AKc )  thng ?")]
    got = dict(spelling.correct(spark.createDataFrame(rows, "query_id long, question string"), known).collect())
    assert got == {1: "What my (AKS) thing?", 2: "Kubernetes 42 THINGS!", 3: "", 4: "", 5: "zzzzzzzzzz my", 6: "What my (AKS) thing?"}


def test_corrections_against_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
    known = {word(): rng.randint(1, 4) for _ in range(150)}
    asked = {word() for _ in range(150)} | {"abcdabcdabcdabcd" * 300}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    def best(w):
        found = []
        for k, n in known.items():
            if abs(len(w) - len(k)) < 3 and (d := edits(w, k)) <= 2:
                swap = any(w[:i] + w[i + 1] + w[i] + w[i + 2 :] == k for i in range(len(w) - 1))
                found.append((1 if d == 1 or swap else 2, -n, k))
        return min(found)[2] if found else None

    want = {w: best(w) for w in asked if w not in known}
    got = dict(spelling.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, n long")).collect())
    assert got == {w: b for w, b in want.items() if b}


def test_prompts(spark):
    asked = spark.createDataFrame([(1, "why?", "EN", "concise"), (2, " ", "en", "expert"), (3, "q", "de", "loud"), (4, "q", "ar", "expert"), (5, "q", None, "detailed")], "query_id long, question string, language string, style string")
    held = [(i, r, "a.md", f"c{r}", f"text {r}", "md" if r == 1 else None, None, 3 if r == 1 else None, 0.25 if r == 1 else None) for i in (1, 2, 3, 5) for r in (1, 2, 3)] + [(4, 1, "a.md", "c1", " ", None, None, None, None)]
    contexts = spark.createDataFrame(held, "query_id long, rank int, source string, chunk_id string, content string, document_format string, source_url string, page_number int, score double")
    got = {r["query_id"]: r for r in prompts.messages(asked, contexts).collect()}
    one = "--- CONTEXT 1 ---\nAUTHORIZED CITATION — COPY EXACTLY:\n[a.md:c1]\nSource: a.md\nChunk ID: c1\nFormat: md\nPage: 3\nReranker score: 0.250000\nContent:\ntext 1"
    two = "--- CONTEXT 2 ---\nAUTHORIZED CITATION — COPY EXACTLY:\n[a.md:c2]\nSource: a.md\nChunk ID: c2\nContent:\ntext 2"
    assert got[1]["user"] == f"QUESTION\nwhy?\n\nCONTEXTS\n{one}\n\n{two}\n\nINSTRUCTIONS\nAnswer briefly."
    assert got[1]["system"].endswith(prompts.REFUSALS["en"]) and got[5]["system"].endswith(prompts.REFUSALS["fr"])
    assert [got[i]["user"] for i in (2, 3, 4)] == [None] * 3 and [got[i]["system"] for i in (2, 3, 4)] == [None] * 3


def test_runs(spark, tmp_path):
    path, start = str(tmp_path / "log"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    name = runs.new_id("Grid search", "a b")
    assert name.startswith("grid_search_a_b_")
    for i, s in enumerate(("created", "running", "completed")):
        runs.note(spark, path, name, "k", "n", s, at=start + timedelta(seconds=i * 1.5))
    runs.note(spark, path, "r2", "k", "n", "completed", at=start)
    runs.note(spark, path, "r3", "k", "n", "created", at=start)
    runs.note(spark, path, "r3", "k", "n", "failed", "why", at=start)
    got = {r["run_id"]: r for r in runs.states(spark.read.parquet(path)).collect()}
    assert (got[name]["status"], got[name]["duration_seconds"], got[name]["valid"]) == ("completed", 1.5, True)
    assert (got["r2"]["valid"], got["r2"]["duration_seconds"]) == (False, None)
    assert (got["r3"]["status"], got["r3"]["error"], got["r3"]["valid"]) == ("failed", "why", True)
    with pytest.raises(ValueError, match="no status"):
        runs.note(spark, path, "r4", "k", "n", "done")


def test_intake(spark, tmp_path):
    (tmp_path / "docs" / "old").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# a")
    (tmp_path / "docs" / "old" / "b.md").write_text("# b")
    spark.createDataFrame([("http://x", "<p>é</p>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    told = [
        {"name": "files", "connector": "Local", "path": str(tmp_path / "docs"), "extensions": ["MD"], "excluded": ["old"]}, {"name": "web", "connector": "pages", "path": str(tmp_path / "pages")},
        {"name": "off", "connector": "local", "enabled": False}, {"name": "gone", "connector": "local", "path": str(tmp_path / "none"), "extensions": [".md"]}, {"name": "odd", "connector": "ftp"},
    ]
    (tmp_path / "sources.json").write_text(json.dumps({"sources": told}))
    files, report = intake.ingest(spark, intake.settings_of(spark, str(tmp_path / "sources.json")))
    assert sorted((r["source"], r["extension"], r["size"]) for r in files.collect()) == [("files", ".md", 3), ("web", ".html", 9)]
    got = {r["source"]: (r["status"], r["files"]) for r in intake.report_counts(files, report).collect()}
    assert got == {"files": ("read", 1), "web": ("read", 1), "off": ("skipped", 0), "gone": ("failed", 0), "odd": ("failed", 0)}
    with pytest.raises(ValueError, match="there already"):
        intake.connector("local")(intake.local_folder)
    assert intake.ingest(spark, [])[0].count() == 0


def test_rows(spark):
    kind = "position long, page_content string, metadata map<string,string>, chunk_id string, source string"
    rows = [(0, " a ", {"chunk_id": " x ", "page": "2", "source": "d\\e.MD"}, None, None), (1, None, None, "y", "f.html"), (2, "b", {"page_number": "3.5"}, None, None)]
    got = [tuple(r)[:6] for r in tables.chunk_rows(spark.createDataFrame(rows, kind)).orderBy("position").collect()]
    assert got == [(0, "x", "a", "d/e.MD", "markdown", 2), (1, "y", "", "f.html", "html", None), (2, "chunk_2", "b", "unknown", "unknown", None)]
    with pytest.raises(Exception, match="id is blank"):
        tables.chunk_rows(spark.createDataFrame([(0, "a", {"chunk_id": " "}, None, None)], kind)).collect()


def test_evidence(spark):
    items = spark.createDataFrame([(1, "A/x.md", "The  End"), (2, "x.md", "none"), (3, "y.md", "the end"), (4, "x.md", " ")], "id long, source string, evidence string")
    pages = spark.createDataFrame([("b\\X.md", "so the end\nis"), ("b\\X.md", "the end")], "source string, content string")
    got = dict(evaluation.evidence_present(items, pages).collect())
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert spark.createDataFrame([(1,)], "a long").select(F.lit(prompts.REFUSALS["ar"]).alias("t")).select(prompts.refused(F.col("t")).alias("r")).first()["r"]
