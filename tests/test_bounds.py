"""What a task and its Python hold does not grow with a table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove.operators import lexical
from lexigrove.operators import retrieval as R
from lexigrove.operators import sections as N
from lexigrove.operators import semantic as T
from lexigrove.sources import html as H
from lexigrove.sources import shared

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def default_batches(spark):
    was = spark.conf.get(NAME)
    spark.conf.set(NAME, "10000")
    yield
    spark.conf.set(NAME, was)


def test_a_file_is_dealt_out_by_its_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_PARTITION", 1000)
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/a b")
    df = spark.read.parquet(f"{tmp_path}/a b")
    size = shared.input_bytes(df)
    assert size > 8000 and shared.spread(df).rdd.getNumPartitions() == -(-size // 1000)
    assert sorted(r.id for r in shared.spread(df).collect()) == list(range(4000))
    assert shared.input_bytes(spark.range(3)) == 0


def test_pages_go_to_python_in_small_batches(spark, default_batches):
    pages = spark.range(1500).selectExpr("id as page_id", "concat('<h1>H', id, '</h1><p>a</p><h2>I</h2><p>b</p>') as html").coalesce(1)
    found = N.clean(H.sections(pages, "page_id", "html"), "page_id")
    assert spark.conf.get(NAME) == str(shared._BATCH)
    assert found.count() == 3000 and {r.n for r in found.groupBy("page_id").count().withColumnRenamed("count", "n").collect()} == {2}


def test_one_row_of_another_form_fails_alone(spark, default_batches):
    pages = spark.range(300).selectExpr("id as page_id", "concat('<h1>H', id, '</h1><p>a</p>') as html").coalesce(1)
    told = N.Function("odd", lambda row: row | {"paragraphs": 7, "heading": "x"} if row["page_id"] == 250 else row).told(H.sections(pages, "page_id", "html"))
    wrong = told.where("error is not null").collect()
    assert [(r.page_id, r.heading, r.paragraphs) for r in wrong] == [(250, "H250", ["a"])] and told.count() == 300


def test_vectors_of_units_do_not_leave_python(spark, default_batches):
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, int(id) * 40), i -> concat('Word', i % 7, ' x', i % 5, '.')), ' ')").alias("text"))
    blocks = T.as_blocks(texts.union(spark.createDataFrame([(99, None), (98, "É a. b")], "doc_id long, text string")))
    made = T.likened(blocks, 4, T.hash_encoder())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "vector" not in plan
    want = T.alike(T.encode(T.units(blocks, 4), "text", T.hash_encoder()))
    assert sorted(made.collect(), key=repr) == sorted(want.select(made.columns).collect(), key=repr)


def test_texts_that_no_result_names_are_not_shuffled(spark, tmp_path):
    spark.range(3000).selectExpr("id as chunk_id", "concat('word', id, ' ', repeat('x', 9000)) as content", "'s' as source").write.parquet(f"{tmp_path}/corpus")
    corpus = spark.read.parquet(f"{tmp_path}/corpus").union(spark.read.parquet(f"{tmp_path}/corpus").where("false"))
    results = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 9)], "query_id long, rank long, chunk_id long")
    kept, texts = R.named(results, corpus)
    assert sorted(r.chunk_id for r in texts.collect()) == [7, 8, 9] and kept.count() == 3
    assert "BroadcastHashJoin" in texts._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in texts._jdf.queryExecution().executedPlan().toString()
    gold = spark.createDataFrame([(1, "word8 x"), (2, "word1 x")], "query_id long, evidence string")
    assert {(r.query_id, r.rank) for r in R.evidence_rank(results, gold, corpus).collect()} == {(1, 2), (2, None)}


def test_questions_of_a_segment_are_scored_together():
    held = lexical._Held(pa.array([10, 11, 12]), np.array([1.0, 2.0, 3.0]), np.array([True, True, False]), 2.0)
    held.block("a", np.array([0, 1, 2]), np.array([1, 1, 5]))
    held.block("b", np.array([1]), np.array([2]))
    asks = pa.array([[], [{"phrase": "a", "idf": 1.0}], [{"phrase": "b", "idf": 2.0}, {"phrase": "c", "idf": 9.0}], [{"phrase": "a", "idf": 1.0}, {"phrase": "b", "idf": 2.0}]], pa.list_(pa.struct([("phrase", pa.string()), ("idf", pa.float64())])))
    nan = float("nan")
    each = lambda asks, least: [(i, at.tolist(), score.tolist()) for i, at, score in held.best(asks, least, 1)]
    together = each(asks.slice(1), np.array([nan, nan, 3.5]))
    assert [t[:2] for t in together] == [(0, [0]), (1, [1]), (2, [1])]
    assert [t[1:] for t in together] == [t[1:] for k in range(1, 4) for t in each(asks.slice(k, 1), np.array([nan]))]
    assert each(asks.slice(1, 1), np.array([9.0])) == [] and each(asks.slice(0, 1), np.array([nan])) == []


def test_a_common_phrase_is_looked_up_not_added_up():
    """Chunks that a question's rare phrase brings near enough are looked up in the others: sums are those of all phrases."""
    held = lexical._Held(pa.array(np.arange(1000)), np.full(1000, 10.0), None, 10.0)
    held.blocks(np.array([0, 1]), np.array([3, 1000]), np.r_[5, 6, 7, np.arange(1000)], np.r_[1, 2, 1, np.full(1000, 3)])
    asks = pa.array([[{"phrase": 0, "idf": 5.0}, {"phrase": 1, "idf": 0.5}]] * 2, pa.list_(pa.struct([("phrase", pa.int64()), ("idf", pa.float64())])))
    whole, pruned = ((at.tolist(), score.tolist()) for _, at, score in held.best(asks, np.array([np.nan, 5.0]), 3))
    assert whole == pruned and whole[0] == [6, 5, 7] and whole[1][1] == whole[1][2] == round(5 + 0.5 * 3 * 2.2 / 4.2, 6)
    held.share[3:] = np.nan  # of the common phrase
    assert [(at.tolist(), score.tolist()) for _, at, score in held.best(asks.slice(1), np.array([5.0]), 3)] == [whole]
    assert list(held.best(asks.slice(1), np.array([50.0]), 3)) == []


def test_many_questions_meet_the_index_in_few_tasks(spark, tmp_path, monkeypatch):
    """Many words are sent to the index, which is not shuffled by word, and a question goes to groups of segments."""
    monkeypatch.setattr(lexical, "_SEGMENT", 4)
    rows = spark.range(0, 400, 1, 2).selectExpr("id as chunk_id", "concat('word', id % 50, ' common rare', id) as content", "'s' as source")
    index = lexical.build_index(rows, f"file://{tmp_path}/index")
    questions = spark.range(40).selectExpr("id as query_id", "concat('word', id, ' common rare', id) as question")
    monkeypatch.setattr(lexical, "_NAMED", 2)
    plan = lexical._wanted(index, lexical.phrases(questions), True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "place" not in plan
    for asked in (200_000, 7):
        monkeypatch.setattr(lexical, "_ASKED", asked)
        found = lexical.bm25(index, questions, 3)
        task = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
        parts = 8 if asked > 40 else 8 * 6  # of 100 segments
        assert f", {parts})" in task.split("Exchange")[1].split("\n")[0]
        best = {r.query_id: r.chunk_id for r in found.where("rank = 1").collect()}
        assert best == {k: k for k in range(40)} and found.count() == 120
