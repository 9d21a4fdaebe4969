"""Hard negatives against plain Python, and the defined cases."""

import numpy as np
import pytest

from lexigrove.llm import hard_negatives
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vec string, slice string, salt int, anchor string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", "s", 2, "a", 3) for r in rows], SCHEMA)


def fit(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def mined(rows, every=100, n=5, k=10, low=30, high=90):
    pin = lambda x: max(-(2**63), min(2**63 - 1, x))
    ints = sorted({(i, label, tuple(pin(int(np.floor(256 * x))) for x in v)) for i, v, label in rows if i is not None and label is not None and fit(v)})
    out = []
    for a, own, x in ints:
        if a % every:
            continue
        scored = sorted((-pin(sum(p * q for p, q in zip(x, y))), i, label) for i, label, y in ints if i != a and len(y) == len(x))
        for minus, p, _ in [s for s in scored if s[2] == own][:n]:
            fits = [s for s in scored if s[2] != own and low * -minus <= 100 * -s[0] <= high * -minus][:k]
            out += [(a, p, r + 1, i, -minus, -s) for r, (s, i, _) in enumerate(fits)]
    return sorted(out)


def test_whole_table(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in hard_negatives.op11_hard_negatives(spark, folder).collect())
    assert got == mined(rows) and len(got) > 100


@pytest.mark.parametrize("copies", [0, 300])
def test_over_many_slices(spark, monkeypatch, copies):
    for name, value in {"_SLICE_ROWS": 40, "_SLICE_BYTES": 40 * 6 * 8, "_STREAM": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [round(float(x), 1) for x in rng.normal(size=6)], i % 4 if i % 9 else 1) for i in range(500)]
    rows += [(500 + i, rows[3][1], i % 2) for i in range(copies)]
    got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(frame(spark, rows), every=50).collect())
    assert got == mined(rows, every=50) and len(got) > 100
    wide = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(frame(spark, rows), every=25, positives=2, k=3, low=-50, high=100).collect())
    assert wide == mined(rows, 25, 2, 3, -50, 100)


def test_defined_cases(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (3, [0.5, 1.0], 3), (4, None, 1), (5, [], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1),
        (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (10, [1.0, 1.0, 1.0], 1), (11, [-3.0, -3.0], 1), (12, [0.0, 0.0], 2), (100, [0.0, 0.0], 1), (200, [1e300, -1e300], 2), (201, [1e300, 1e9], 2), (202, [1e15, 0.0], 1), (300, [2.0, 2.0], 7),
    ]
    got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(frame(spark, rows)).collect())
    assert got == mined(rows)
    assert {r[0] for r in got} >= {0, 100} and not any(r[0] == 300 for r in got)
    assert hard_negatives.mine_hard_negatives(frame(spark, rows).where("vec_id > 9999")).count() == 0


def test_labels_move(spark, tmp_path):
    """Labels of any size move, where the id is divisible by 7."""
    rows = [(i, [1.0, float(i % 5)], {0: 2**31 - 1, 7: -1, 14: 9, 21: None}.get(i, i % 3)) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = mined([(i, v, x if i % 7 or x is None else int(np.fmod(x + 1, 10))) for i, v, x in rows])
    assert sorted(tuple(r) for r in hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect()) == want
