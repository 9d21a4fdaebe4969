"""Operators on vectors against plain numpy, and their defined cases."""

import numpy as np
import pytest

from lexigrove.llm import embedding_dedup, top_k
from tests.conftest import DATA
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, cls string, node string, bucket int, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", "c", "n", 2, 3) for r in rows], SCHEMA)


def fit(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def best(rows, every=50, k=5):
    ints = sorted({(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and fit(v)})
    out = []
    for q, x in ints:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def links(rows, least=0.98):
    unit = {}
    for i, v, label in rows:
        if fit(v) and any(v) and label is not None:
            x = np.array(v, float)
            unit[i] = (label, x / np.sqrt((x**2).sum()))
    found = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= least]
    component = brute.smallest_reachable([r[0] for r in rows], found)
    return {i: (sum(i in p for p in found), component[i], component[i] == i) for i in component}


@pytest.fixture(scope="module")
def small(spark):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/embeddings.parquet").collect()]


def test_top_k(spark, small):
    got = sorted(tuple(r) for r in top_k.op6_top_k(spark, DATA.replace("sf0.001", "sf0.01")).collect())
    assert got == best([x[:2] for x in small])


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_top_k_over_many_buckets(spark, monkeypatch, spread):
    for name, value in {"_BUCKET_ROWS": 40, "_BUCKET_BYTES": 40 * 12 * 8, "_BLOCK": 4, "_STREAM": 5}.items():
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=12)) * rng.lognormal(0, 1)) for i in range(600)]
    rows = [(i, [round(float(x), 1) for x in v]) for i, v in rows] + [(i, [1.0] * 12) for i in range(600, 680)]
    got = sorted(tuple(r) for r in top_k.top_products(frame(spark, [(*r, 0) for r in rows])).collect())
    assert got == best(rows)


def test_top_k_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (100, [-1.0, 0.5]), (8, [1e9, 1e9])]
    got = sorted(tuple(r) for r in top_k.top_products(frame(spark, [(*r, 0) for r in rows])).collect())
    assert got == best(rows)
    assert top_k.top_products(frame(spark, [(1, [1.0], 0)]).where("vec_id > 1")).count() == 0


def test_top_k_of_huge_components(spark):
    """Components and scores beyond 64 bits are pinned to the ends."""
    pin = lambda x: max(-(2**63), min(2**63 - 1, x))
    rows = [(0, [1e9, 1e9]), (1, [1e9, -1e9]), (2, [3e9, 1e9]), (3, [1e300, -1e300]), (4, [-1e300, -1e300]), (5, [1e-3, 1.0]), (50, [1.0, 1.0])]
    ints = {i: [pin(int(np.floor(256 * x))) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        scores = sorted((-pin(sum(a * b for a, b in zip(ints[q], ints[i]))), i) for i in ints if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    got = sorted(tuple(r) for r in top_k.top_products(frame(spark, [(*r, 0) for r in rows])).collect())
    assert got == want


def test_links(spark, small):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op10_embedding_dedup(spark, DATA.replace("sf0.001", "sf0.01")).collect()}
    assert got == links(small)


def test_links_over_many_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "_BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 24))
    rows = [(i, [float(x) for x in (centres[i % 20] + rng.choice([0.05, 0.12, 0.3]) * rng.normal(size=24)) * rng.uniform(0.1, 9)], i % 3 if i % 11 else None) for i in range(900)]
    rows += [(900 + i, rows[1][1], 1) for i in range(40)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup_embeddings(frame(spark, rows), per_list=20).collect()}
    assert got == links(rows)
    assert sum(n for n, _, _ in got.values()) > 500


def test_links_defined_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [1e-200, 0.0], 1), (12, [1e200, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup_embeddings(frame(spark, rows)).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}
    assert got == alone | {1: (3, 1, True), 2: (3, 1, False), 11: (3, 1, False), 12: (3, 1, False)}
    twice = embedding_dedup.dedup_embeddings(frame(spark, [(1, [1.0], 1), (1, [1.0], 1), (None, [1.0], 1)])).collect()
    assert sorted((r["vec_id"] is None, r["n_links"], r["kept"]) for r in twice) == [(False, 1, True), (False, 1, True), (True, 0, True)]
    assert embedding_dedup.dedup_embeddings(frame(spark, rows).where("vec_id > 99")).count() == 0
