"""Search queries over more rows than the smallest tables have."""

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from lexigrove.operators import retrieval
from lexigrove.plans import search


@pytest.mark.parametrize(("items", "vectors"), [(250, 300), (250, 230), (0, 5)])
def test_every_passage_has_its_vector(spark, tmp_path, items, vectors):
    d, rng = str(tmp_path), np.random.default_rng(1)
    ids = [int(x) for x in rng.permutation(vectors) * 7]
    rows = [(i, rng.normal(size=8).tolist()) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i * 3, "a") for i in range(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r["query_id"]: r["query_vector"] for r in search.query_vectors(spark, d).collect()}
    want = [v for _, v in sorted(rows)][:items]
    assert sorted(got) == [i * 3 for i in range(len(want))] and all(got[i * 3] == pytest.approx(v, abs=1e-6) for i, v in enumerate(want))
    if items < vectors:
        found = sorted(map(tuple, search.vector_topk(spark, d).select("query_id", "rank", "chunk_id", "cosine_similarity").collect()))
        con = duckdb.connect()
        for t in ("embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
        con.execute("CREATE VIEW documents AS SELECT 1::BIGINT AS doc_id, 'a' AS text, 'b' AS source, 'en' AS lang")
        assert found == sorted(con.execute(f"SELECT query_id, rank, chunk_id, cosine_similarity FROM ({search.ORACLE['vector_topk']})").fetchall())


def neighbours(chunks, queries, top):
    out = []
    for q, x in queries:
        fit = [(c, v) for c, v in chunks if v is not None and len(v) == len(x) and None not in v and np.isfinite(v).all() and any(v)]
        scored = sorted((-round(float(np.clip(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v), -1, 1)), 6), c) for c, v in fit)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:top])]
    return sorted(out)


@pytest.mark.parametrize("held", [64 << 20, 5 * 6 * 8])  # questions in every task, and dealt into blocks
def test_neighbours(spark, monkeypatch, held):
    monkeypatch.setattr(retrieval, "_ASKED_BYTES", held)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [0.0] * 6), (906, [1.0] * 5)]
    rows += [(1000 + i, rows[4][1]) for i in range(40)]
    asked = [(f"q{i}", rng.normal(size=6).tolist()) for i in range(23)] + [("same", rows[4][1])]
    chunks, queries = spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id string, query_vector array<double>")
    got = sorted((r[0], r[1], r[2], round(r[3], 6)) for r in retrieval.nearest(chunks, queries, 7).collect())
    assert got == [(q, r, c, round(s, 6)) for q, r, c, s in neighbours(rows, asked, 7)]
    assert retrieval.nearest(chunks, queries.where("false")).count() == 0 and retrieval.nearest(chunks.where("false"), queries).count() == 0
    some = retrieval.nearest(chunks, queries, 3, keep=F.col("chunk_id") % 2 == 0, measure="inner")
    assert some.columns == ["query_id", "rank", "chunk_id", "inner_product", "distance"] and {r["chunk_id"] % 2 for r in some.collect()} == {0}


@pytest.mark.parametrize("bad", [None, [], [1.0, None], [1.0, float("nan")], [float("-inf"), 1.0], [0.0, 0.0], [1.0, 2.0, 3.0]])
def test_a_bad_question_fails(spark, bad):
    """No question is lost in silence."""
    chunks = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "query_id long, query_vector array<double>")
    with pytest.raises(ValueError, match="questions"):
        retrieval.nearest(chunks, queries)
