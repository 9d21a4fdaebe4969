"""Rules of question sets and of lists of files."""

from lexigrove.operators import manifest


def test_question_set(spark):
    shape = "id long, question string, answerable boolean, expected_source string, evidence string"
    good = [(i, f"q {i}", i < 2, "a.md" if i < 2 else None, "text" if i < 2 else "") for i in range(4)]
    told = lambda rows: {r["rule"]: r["failures"] for r in manifest.dataset_rules(spark.createDataFrame(rows, shape), 2, 2).collect()}
    assert set(told(good).values()) == {0} and len(told(good)) == 7
    bad = [(0, "q", True, None, "x"), (0, " Q ", None, "a.md", None), (1, None, False, None, "x")]
    assert told(bad) == {"unique_ids": 1, "unique_questions": 1, "filled_questions": 1, "answerable_count": 1, "unanswerable_count": 0, "answerable_has_evidence": 1, "unanswerable_has_none": 2}


def test_files(spark):
    wanted = spark.createDataFrame([("/b.MD",), ("/A.html",), ("/c.exe",), ("/d.md",), ("/gone.md",), ("/noending",)], "path string")
    files = spark.createDataFrame([("/b.MD", 3), ("/A.html", 1), ("/c.exe", 2), ("/d.md", 0), ("/noending", 1)], "path string, size long")
    got = [tuple(r) for r in manifest.file_checks(wanted, files, ("md", ".HTML")).collect()]
    assert got == [("/A.html", None), ("/b.MD", None), ("/c.exe", "unsupported"), ("/d.md", "empty"), ("/gone.md", "missing"), ("/noending", "unsupported")]
