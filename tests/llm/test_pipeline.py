"""The pipeline against plain Python on the smallest table, with the trained model's decisions taken as they are."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import toxicity
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_documents import frame, ids_of, reference_bpe  # noqa: F401


def test_stages_are_named():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_run(spark, reference_bpe):  # noqa: F811
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).where("predicted = 0").collect()}
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in clean}
    texts = {i: t for i, _, _, t in brute.lines([(i, t) for i, (t, _) in rows.items()])}
    kept = [i for i, (_, component) in brute.near(list(texts.items()), 80).items() if i == component]
    mixed = brute.mix([(i, rows[i][1], len(brute.WORD.findall(texts[i]))) for i in kept])
    want = []
    for i, _, _, _, copies in mixed:
        ids = ids_of(reference_bpe, texts[i])
        want += [(i, len(ids) // 4, brute.sha(ids), brute.sha(texts[i]))] * copies
    got = [tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_the_columns_and_odd_rows(spark, tmp_path, empty):
    rows = [(1, "a b c d e f", "en", "s"), (2, None, None, None), (3, "", "en", None), (None, "x y z", "en", "s"), (4, "a b c d e f", "en", "s"), (4, "a b c d e f", "en", "s")]
    docs = frame(spark, rows).withColumns({"predicted": F.lit(7), "column 1": F.array(F.lit("x")), "text2": F.struct(F.lit(1).alias("a b")), "row": F.lit("r"), "key": F.lit(1.5)})
    docs = docs.where("doc_id < 0") if empty else docs
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert all((r["predicted"], r["score"], r["h"], r["text2"]["a b"], r["column 1"], r["key"]) == (7, "s", 6, 1, ["x"], 1.5) for r in docs.collect())
    assert (docs.count() == 0) == empty
    assert np.all([r["decoded_sha256"] is not None for r in docs.collect()])
