"""The index of segments and BM25 over it against a plain version."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.operators import lexical
from lexigrove.sources import shared

KEPT = "chunk_id long, content string, source string, lang string"


def terms(text):
    table = dict(zip(X.ACCENTED, X.PLAIN))
    return re.findall(r"[^\W_]+", "".join(table.get(c, c) for c in (text or "").lower()))


def plain(rows, questions, top=10, keep=None):
    """[(query_id, rank, chunk_id, score)] by scoring every chunk."""
    held = [(c, [terms(content), terms(str(c)), terms(source)]) for c, content, source, _ in rows]
    length = [sum(map(len, f)) for _, f in held]
    mean = sum(length) / len(held) if held else 0
    out = []
    for q, question in questions:
        found = re.findall(r"[a-z0-9][a-z0-9_-]*", question.strip().lower())
        kept = [t for t in found if t not in X.STOPWORDS and len(t) >= 2] or found
        total = Counter()
        for phrase in dict.fromkeys(kept):
            parts = re.findall(r"[^\W_]+", phrase)
            tf = {k: n for k, (_, fields) in enumerate(held) if (n := sum(f[i : i + len(parts)] == parts for f in fields for i in range(len(f))))}
            idf = math.log((len(held) - len(tf) + 0.5) / (len(tf) + 0.5))
            for k, n in tf.items():
                total[k] += (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[k] / mean))
        scored = sorted((round(-s, 6), held[k][0]) for k, s in total.items() if keep is None or held[k][0] in keep)
        out += [(q, r + 1, c, s) for r, (s, c) in enumerate(scored[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Größe", "a-b", "x_y", "naïve"]
    rows = [(i, " ".join(["everywhere"] + rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))), rng.choice(("alpha.md", "beta_w3.md", None)), rng.choice(("en", "de"))) for i in range(400)]
    rows += [(400, None, None, "en"), (401, "", "w1", "en"), *[(500 + i, "w1 w2 everywhere w39", "alpha.md", "en") for i in range(60)]]
    return rows


ASKED = [(1, "w1 w2 w39"), (2, "everywhere"), (3, "grosse Größe naive"), (4, "a-b x_y"), (5, "the of"), (6, "nothing-like-this zzz"), (7, ""), (8, "W3 w4 w5 w6 w7 w8 w9 beta_w3"), (9, "w1 w2"), (10, "w2_everywhere"), (11, "401")]


@pytest.mark.parametrize(("segment", "named"), [(2048, 2000), (16, 2000), (7, 2)])
def test_bm25(spark, corpus, monkeypatch, tmp_path, segment, named):
    monkeypatch.setattr(lexical, "_SEGMENT", segment)
    monkeypatch.setattr(lexical, "_NAMED", named)
    monkeypatch.setattr(lexical, "_FIRST", 2)
    monkeypatch.setattr(lexical, "_FEW", 4)
    table, asked = spark.createDataFrame(corpus, KEPT), spark.createDataFrame(ASKED, "query_id long, question string")
    index = lexical.build_index(table, f"file://{tmp_path}/index")
    assert index.headers.agg(F.max(F.size("ids"))).first()[0] <= max(segment, 1)
    for top in (1, 10, 1000):
        assert rows_of(lexical.bm25(index, asked, top)) == plain(corpus, ASKED, top)
    keep = table.where("lang = 'de'").select("chunk_id")
    assert rows_of(lexical.bm25(index, asked, keep=keep)) == plain(corpus, ASKED, keep={r[0] for r in corpus if r[3] == "de"})
    counted = Counter(t for c, content, source, _ in corpus for t in terms(content) + terms(str(c)) + terms(source))
    assert {r["term"]: r["n_total"] for r in index.terms().collect()} == counted


def test_a_word_of_every_chunk_is_many_blocks(spark, monkeypatch, tmp_path):
    """No segment or file holds more than its share of a word that stands everywhere, and terms are pushed to the scan."""
    monkeypatch.setattr(lexical, "_SEGMENT", 50)
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("chunk_id"), F.concat(F.lit("everywhere w"), F.col("id") % 97).alias("content"), F.lit("s").alias("source"))
    index = lexical.build_index(rows, f"file://{tmp_path}/index")
    hot = index.blocks.where("term = 'everywhere'").withColumn("file", F.input_file_name())
    assert hot.agg(F.max("n")).first()[0] <= 50
    each = [r["n"] for r in hot.groupBy("file").agg(F.sum("n").alias("n")).collect()]
    assert sum(each) == 4000 and max(each) <= 2 * sorted(each)[len(each) // 2]
    asked = lexical.phrases(spark.createDataFrame([(1, "w5 w6")], "query_id long, question string"))
    plan = lexical._wanted(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[w5,w6\]\)", plan)


def test_few_segments_are_scored_in_full(spark, monkeypatch):
    """A question whose terms stand together in one place leaves the other segments out."""
    monkeypatch.setattr(lexical, "_SEGMENT", 20)
    monkeypatch.setattr(lexical, "_FIRST", 1)
    monkeypatch.setattr(lexical, "_FEW", 1)
    rows = [(i, "rare words meet here " * 3 if i < 12 else f"rare {'long filler text ' * 40}", "s", "en") for i in range(400)]
    table = spark.createDataFrame(rows, KEPT).coalesce(1)
    asked = [(1, "rare words meet")]
    got = rows_of(lexical.bm25(table, spark.createDataFrame(asked, "query_id long, question string")))
    assert got == plain(rows, asked)


def test_empty(spark):
    none = spark.createDataFrame([], KEPT)
    asked = spark.createDataFrame(ASKED, "query_id long, question string")
    assert lexical.bm25(none, asked).count() == 0
    assert lexical.bm25(spark.createDataFrame([(1, "w1", "s", "en")], KEPT), asked.where("false")).count() == 0


def test_an_index_appears_whole(spark, tmp_path):
    """What another session has put there stays, and a failure leaves nothing under the name."""
    path = f"file://{tmp_path}/one"
    spark.createDataFrame([(1,)], "a int").write.parquet(path)
    shared.publish(spark, path, lambda folder: spark.createDataFrame([(2,)], "a int").write.parquet(folder))
    assert [r["a"] for r in spark.read.parquet(path).collect()] == [1] and [p.name for p in tmp_path.iterdir()] == ["one"]

    def fails(folder):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        shared.publish(spark, f"file://{tmp_path}/two", fails)
    assert not shared.exists(spark, f"file://{tmp_path}/two")


def test_fingerprint_follows_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    before = shared.fingerprint(spark, path)
    assert before == shared.fingerprint(spark, path)
    spark.range(5).write.mode("append").parquet(path)
    assert shared.fingerprint(spark, path) != before


def test_scratch_is_released(spark):
    shared.release(spark)
    rows = shared.kept(spark.range(5), "kept")
    asked = spark.createDataFrame(ASKED[:2], "query_id long, question string")
    found = lexical.bm25(spark.createDataFrame([(1, "w1 w2", "s", "en")], KEPT), asked)
    assert rows.count() == 5 and found.count() == 1
    assert shared.release(spark) >= 2 and shared.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        rows.count()
