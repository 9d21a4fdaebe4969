"""Importance resampling against plain Python, and the defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrove.llm import importance
from tests.conftest import DATA
from tests.llm.brute import UPPER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, id string, weight string, score string, rank string, n int, bucket int, c0 string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "i", "w", "x", "r", 1, 2, "c") for r in rows], SCHEMA)


def features(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def drawn(rows, target, many=10_000, longest=1, least=20, share=(10, 100)):
    bucket = lambda f: zlib.crc32(f.encode()) % many
    s = Counter(bucket(f) for _, text in rows for f in features(text, longest)[0])
    t = Counter(bucket(f) for text in target for f in features(text, longest)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + many) / ((s[b] + 1) * (t.total() + many)))) for b in s}
    out = []
    for doc, text in rows:
        found, words = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: share[0] * len(fit) // share[1]]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_whole_table(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    want = drawn([(r["doc_id"], r["text"]) for r in read("documents").collect()], [r["text"] for r in read("benchmark").collect()])
    assert rows_of(importance.op13_importance(spark, DATA)) == want


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_ties_and_long_texts(spark, longest):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 40))) for i in range(120)] + [(200, "x" * (1 << 20)), (201, "Größe ÄA 日本 x-y_z " * 3000)]
    target = ["w1 w2 w3 größe"] * 3 + [None, ""]
    got = importance.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), many=50, longest=longest, least_words=5, share=(1, 3))
    assert rows_of(got) == drawn(rows, target, 50, longest, 5, (1, 3))


def test_one_score_of_many_documents(spark, monkeypatch):
    """Ranks within one score go on by id, whatever the number of tasks."""
    monkeypatch.setattr(importance, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    rows = [(i, "a b c d e f") for i in range(400)]
    got = importance.resample(frame(spark, rows), frame(spark, []), least_words=1, share=(1, 4))
    assert [r["rank"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == [*range(1, 101), *[None] * 300]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "... !!"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, "A B C d")]
    target = spark.createDataFrame([("a",)], "text string")
    got = importance.resample(frame(spark, rows), target, least_words=1, share=(1, 1), carry=("source", "id", "text"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "source", "id", "text"]
    assert rows_of(got) == drawn(rows, ["a"], least=1, share=(1, 1))
    assert all(r["source"] == "s" and r["id"] == "i" for r in got.collect())
    assert [r["rank"] for r in importance.resample(frame(spark, rows), target, share=(1, 1)).collect()] == [None] * 7
    assert importance.resample(frame(spark, []), target).count() == 0
    assert rows_of(importance.resample(frame(spark, rows), target.where("false"), least_words=1, share=(1, 1))) == drawn(rows, [], least=1, share=(1, 1))
