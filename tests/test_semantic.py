"""Semantic chunks: the turn of a subject, sizes, overlaps and packing against a plain version; encoders that fail."""

import random

import numpy as np
import pytest

from lexigrove.operators import semantic
from lexigrove.operators.retrieval import hyde_texts

BLOCKS = "doc_id string, block_index long, block_type string, text string"
SUBJECTS = (("river", "bridge", "zone", "harbour", "flood"), ("tax", "cost", "rent", "price", "loan"))


def keywords():
    """An encoder that knows two subjects and the rest."""
    return lambda texts: np.array([[float(any(w in t.lower() for w in s)) for s in SUBJECTS] + [float(not any(w in t.lower() for s in SUBJECTS for w in s))] for t in texts], np.float32)


def chunks(spark, rows, make=keywords, **settings):
    return sorted(semantic.semantic_chunks(spark.createDataFrame(rows, BLOCKS), lambda: make(), **settings).collect(), key=lambda r: (r["doc_id"], r["chunk_index"]))


TWO = [
    ("d", 0, "heading", "River works"), ("d", 1, "paragraph", "The harbour lies behind a bridge. A wall keeps the flood from old warehouses."),
    ("d", 2, "heading", "Rent and tax"), ("d", 3, "paragraph", "Each loan has a price of its own. Taxes rise with the cost of land."),
]


def test_a_chunk_ends_where_the_subject_turns(spark):
    got = chunks(spark, TWO, size=30, overlap=3, least=1)
    assert [r["boundary"] for r in got] == ["semantic_threshold", "document_end"]
    assert "harbour" in got[0]["content"].lower() and "loan" in got[1]["content"].lower()
    assert got[1]["content"].startswith("from old warehouses. Rent and tax") and got[1]["overlap_tokens"] == 3
    assert [(r["first_unit"], r["last_unit"], r["least_similarity"]) for r in got] == [(0, 2, 1.0), (3, 5, 1.0)]


def test_sizes(spark):
    text = " ".join(f"river_{i}" for i in range(27))
    got = chunks(spark, [("a", 0, "paragraph", text), ("b", 0, "code", "x. y. z. " * 9)], size=10, overlap=0, least=1)
    assert [(r["doc_id"], r["token_count"], r["boundary"]) for r in got] == [("a", 10, "chunk_size"), ("a", 10, "chunk_size"), ("a", 7, "document_end"), ("b", 10, "chunk_size"), ("b", 10, "chunk_size"), ("b", 7, "document_end")]
    assert " ".join(r["content"] for r in got if r["doc_id"] == "a") == text


def test_repeats_blanks_and_empty(spark):
    got = chunks(spark, [("a", 0, "paragraph", "one zone. " * 4), ("b", 0, "paragraph", None), ("b", 1, "code", "  "), ("c", 0, "paragraph", "cost")], size=2, overlap=0)
    assert [(r["doc_id"], r["chunk_index"], r["content"], r["least_similarity"]) for r in got] == [("a", 0, "one zone.", None), ("c", 0, "cost", None)]
    assert chunks(spark, [("b", 0, "paragraph", None)]) == []


def plain(parts, likes, size, overlap, least, threshold):
    """[(content, boundary)] for sentences and the likeness of each to the one before."""
    out, held, fresh = [], [], 0
    for part, like in zip(parts, likes):
        n = sum(len(p.split()) for p in held)
        turned = fresh and like < threshold and n >= least
        if turned or (fresh and n + len(part.split()) > size):
            out.append((" ".join(held), "semantic_threshold" if turned else "chunk_size"))
            tail = " ".join(held).split()[-overlap:] if overlap else []
            held, fresh = ([" ".join(tail)] if tail and len(tail) + len(part.split()) <= size else []), 0
        held, fresh = [*held, part], fresh + 1
    out.append((" ".join(held), "document_end"))
    return [x for i, x in enumerate(out) if not i or x[0] != out[i - 1][0]]


@pytest.mark.parametrize(("size", "overlap", "least", "threshold"), [(12, 0, 1, 0.5), (12, 4, 6, 0.3), (40, 5, 10, 0.9)])
def test_packing(spark, size, overlap, least, threshold):
    rng = random.Random(size + overlap)
    docs = {f"d{i}": [" ".join(rng.choices(["zone", "cost", "sky", "price", "rain", "failure"], k=rng.randint(1, 9))) + "." for _ in range(rng.randint(1, 60))] for i in range(12)}
    encode = semantic.hash_encoder(16)()
    got = chunks(spark, [(d, 0, "paragraph", " ".join(s)) for d, s in docs.items()], make=lambda: encode, size=size, overlap=overlap, least=least, threshold=threshold)
    for d, sentences in docs.items():
        x = semantic.checked(encode(sentences), len(sentences), None)
        likes = [None, *[round(float(a @ b), 6) for a, b in zip(x, x[1:])]]
        assert [(r["content"], r["boundary"]) for r in got if r["doc_id"] == d] == plain(sentences, likes, size, overlap, least, threshold)
        assert all(r["token_count"] == len(r["content"].split()) <= size for r in got)


@pytest.mark.parametrize("bad", [lambda t: np.ones((len(t), 3)) * np.nan, lambda t: np.zeros((len(t), 3)), lambda t: np.ones((len(t) + 1, 3)), lambda t: np.ones(len(t)), lambda t: np.ones((len(t), 4))])
def test_an_encoder_that_fails_is_told(spark, bad):
    with pytest.raises(Exception, match="encoder returned"):
        chunks(spark, TWO, make=lambda: bad, dimension=3)


def test_questions(spark):
    asked = spark.createDataFrame([(1, " What does a zone cost? "), (2, "rain")], "query_id long, question string")
    seen = lambda: lambda texts: np.array([[len(t), t.startswith("query: ")] for t in texts], float)
    got = {r["query_id"]: r["query_vector"] for r in semantic.embed_questions(asked, seen, 2).collect()}
    assert got[1] == pytest.approx(list(np.array([29, 1]) / np.sqrt(842)))
    with pytest.raises(Exception, match="empty text"):
        semantic.embed_questions(spark.createDataFrame([(1, " ")], "query_id long, question string"), seen).collect()
    with pytest.raises(Exception, match="hypothetical"):
        hyde_texts(asked, spark.createDataFrame([(1, "x")], "query_id long, hyde_document string")).collect()
