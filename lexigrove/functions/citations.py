"""Citations in an answer: found, made canonical, and held against those allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.functions.text import strip, text_of

#: File kinds whose point a model may write as an underscore.
KINDS = ("md", "pdf", "html", "htm", "txt")


def extract(answer) -> Column:
    """Distinct bracketed parts with a colon, without a leading label, in order."""
    inner = F.regexp_extract_all(text_of(answer), F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    inner = F.transform(inner, lambda x: strip(F.regexp_replace(strip(x), r"^(?i:source|citation|reference|ref)[ \t\r\n]*:[ \t\r\n]*", "")))
    return F.array_distinct(F.transform(F.filter(inner, lambda x: x.contains(":")), lambda x: F.concat(F.lit("["), x, F.lit("]"))))


def canonical(citation: Column) -> Column:
    for kind in KINDS:
        citation = F.replace(citation, F.lit(f"__{kind}__chunk_"), F.lit(f".{kind}__chunk_"))
    return citation


def verdict(answer, allowed: Column, required: bool = True) -> Column:
    """struct(valid, detected, valid_citations, invalid_citations, missing, outcome)."""
    found = F.transform(extract(answer), canonical)
    good = F.filter(found, lambda x: F.array_contains(allowed, x))
    bad = F.filter(found, lambda x: ~F.array_contains(allowed, x))
    none = F.array().cast("array<string>")
    outcome = (
        F.when(strip(text_of(answer)) == "", "empty_answer").when(F.size(allowed) == 0, "no_context")
        .when(F.lit(required) & (F.size(found) == 0), "no_citation").when(F.size(bad) > 0, "unauthorized_citation").otherwise("valid")
    )
    early = outcome.isin("empty_answer", "no_context", "no_citation")
    return F.struct(
        (outcome == "valid").alias("valid"), F.when(early, none).otherwise(found).alias("detected"), F.when(early, none).otherwise(good).alias("valid_citations"),
        F.when(early, none).otherwise(bad).alias("invalid_citations"), F.when(outcome == "no_citation", allowed).otherwise(none).alias("missing"), outcome.alias("outcome"),
    )
