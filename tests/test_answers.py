"""Functions around a model, provider chains, and the summary of a question suite."""

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import queries as Q
from lexigrove.operators import providers


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (lambda c: Q.normalised_output(c, F.lit("what is x")), "```text\nNormalized query: 'What is X?'\n```", "What is X?"),
        (lambda c: Q.normalised_output(c, F.lit("q")), "Answer: it is", None),
        (lambda c: Q.normalised_output(c, F.lit("q")), "a\nb", None),
        (lambda c: Q.normalised_output(c, F.lit("q")), "x" * 121, None),
        (lambda c: Q.normalised_output(c, F.lit("q")), "# title", None),
        (Q.display, "It is so [a.md:x__chunk_3] , yes.\n\n\n\nNext [1]", "It is so, yes.\n\nNext [1]"),
        (Q.final_answer, "think <FINAL>\n yes </final>", "yes"),
        (lambda c: Q.expanded(c, F.lit("abc")), "abc", "abc"),
        (lambda c: Q.expanded(c, F.lit("abc")), "ABC", "ABC\nabc"),
        (Q.to_boolean, " Yes ", True),
        (Q.to_boolean, "maybe", None),
        (Q.to_optional_double, " ", None),
        (Q.to_optional_double, "1.5", 1.5),
        (lambda c: Q.bytes_text(F.length(c) * 512), "abc", "1.5 KB"),
        (lambda c: Q.bytes_text(F.length(c)), "abc", "3 B"),
        (lambda c: Q.first_tokens(c, 2), "a  b c", "a b"),
        (lambda c: Q.last_tokens(c, 2), "a  b c", "b c"),
        (lambda c: Q.last_tokens(c, 9), "a  b c", "a b c"),
        (lambda c: Q.split_by_tokens(c, 2), "a b c", ["a b", "c"]),
        (lambda c: Q.title(F.lit(" "), path=c), "docs/my-first_page.MD", "My First Page"),
        (lambda c: Q.document_id(F.lit("s"), c), "docs/A.b.MD", "s:a.b"),
        (lambda c: Q.prefixed(c, "query"), "x", "query: x"),
        (lambda c: Q.rewrite_accepted(c, F.lit("q")), "one\ntwo", False),
        (lambda c: Q.source_url(F.create_map(F.lit("url"), F.lit(" "), F.lit("web_url"), c)), "u", "u"),
    ],
)
def test_functions(spark, fn, text, want):
    assert value(spark, text, fn) == want


def test_front_matter(spark):
    got = value(spark, "---\ntitle: 'A b'\nms.date: 2024: x\nno pair\ntitle: twice\n---\n# Body\n", Q.front_matter)
    assert got["values"] == {"title": "A b", "ms.date": "2024: x"} and got["body"] == "# Body\n"
    assert value(spark, "plain", Q.front_matter)["values"] == {}
    with pytest.raises(Exception, match="no final answer"):
        value(spark, "nothing", Q.final_answer)


def test_fallback(spark):
    def slow(prompt):
        raise TimeoutError("too late")

    asked = spark.createDataFrame([(1, "p1"), (2, "p2")], "query_id long, prompt string")
    chain = [("first", slow), ("bare", lambda p: "no citation"), ("second", lambda p: f"{p} [a:1]" if p == "p1" else "none")]
    got = {r["query_id"]: r for r in providers.generate(asked, chain, lambda a, row: None if "[" in a else "no citation", retries=1).collect()}
    assert (got[1]["answer"], got[1]["provider"]) == ("p1 [a:1]", "second")
    assert [(x["provider"], x["attempt"], x["ok"]) for x in got[1]["attempts"]] == [("first", 1, False), ("first", 2, False), ("bare", 1, False), ("second", 1, True)]
    assert got[2]["answer"] is None and got[2]["attempts"][-1]["error"] == "no citation"


def test_suite(spark):
    rows = [(True, True, True, 10, 2, True, False, 5.0), (True, False, False, None, None, False, False, 1.0), (False, False, True, 7, 1, False, True, 9.0)]
    df = spark.createDataFrame(rows, "expected boolean, predicted boolean, llm_called boolean, input_tokens long, output_tokens long, citations_valid boolean, llm_failed boolean, total_ms double")
    s = providers.suite_summary(df).first()
    assert (s["true_positive"], s["true_negative"], s["false_positive"], s["false_negative"], s["llm_calls"], s["input_tokens"]) == (1, 1, 0, 1, 2, 17)
    assert (s["accuracy"], s["citation_validity"], s["mean_total_ms"], s["median_total_ms"]) == (0.666667, 0.5, 5.0, 5.0)
    assert [r["errors"] for r in providers.suite_errors(df).orderBy("total_ms").collect()] == [["wrong_prediction"], ["invalid_citations", "failed_llm"]]
