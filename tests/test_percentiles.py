"""Percentiles by selection against numpy, and thresholds by dominance against trying each."""

import itertools
import random

import numpy as np
import pytest

from lexigrove.operators import evaluation, percentiles

P = {"low": 0.0, "median": 0.5, "p95": 0.95, "odd": 0.37, "high": 1.0}


@pytest.mark.parametrize(("sorted_", "pivots"), [(5000, 500), (3, 8), (20, 16)])
def test_percentiles(spark, monkeypatch, sorted_, pivots):
    monkeypatch.setattr(percentiles, "_SORTED", sorted_)
    monkeypatch.setattr(percentiles, "_PIVOTS", pivots)
    rng = np.random.default_rng(3)
    rows = [("wide", float(x), 1.0) for x in rng.lognormal(0, 20, 700)] + [("ties", float(x), None) for x in rng.integers(0, 4, 600)] + [("one", 5.5, 2.0), ("none", None, None), (None, 1.0, 3.0), (None, 2.0, 3.0)]
    rows += [("far", x, 0.0) for x in [-1e300, 1e300, 1e-300, 0.0, -0.0] + [7.0] * 300] + [("even", float(x), float(-x)) for x in range(10)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(4)
    got = {r["g"]: r for r in percentiles.percentiles(df, ("a", "b"), P, ("g",)).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        for k, c in ((1, "a"), (2, "b")):
            own = [x[k] for x in rows if x[0] == g and x[k] is not None]
            for name, p in P.items():
                assert r[f"{name}_{c}"] == (pytest.approx(float(np.percentile(own, 100 * p)), rel=1e-12) if own else None), (g, c, name)
    (whole,) = percentiles.percentiles(df, ("a",), {"median": 0.5}).collect()
    assert whole["median_a"] == pytest.approx(float(np.median([x[1] for x in rows if x[1] is not None])))
    assert percentiles.percentiles(df.where("false"), ("a",), {"median": 0.5}, ("g",)).count() == 0


def test_latencies_of_several_columns(spark):
    rows = [("x", float(i), float(i * i)) for i in range(21)] + [("y", 4.0, None)]
    got = {r["m"]: r for r in evaluation.latencies(spark.createDataFrame(rows, "m string, embed double, total double"), ("embed", "total"), "m").collect()}
    assert (got["x"]["median_embed"], got["x"]["p95_total"], got["x"]["n_total"]) == (10.0, 361.0, 21)
    assert (got["y"]["p95_embed"], got["y"]["median_total"], got["y"]["total_total"]) == (4.0, None, None)


def test_thresholds(spark):
    rng = random.Random(2)
    pick = lambda *v: rng.choice(v)
    rows = [(i, pick(0.1, 0.3, 0.5, 0.94, 0.95, 1.0, None), pick(0.0, 0.02, 0.3, None), pick(None, 0.5, 0.65, 0.9), pick(None, 0.01, 0.015, 0.03), rng.randint(0, 4), rng.random() < 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id long, top1_score double, margin double, top1_cosine double, top1_rrf double, supporting long, expected boolean")
    values = dict(zip(evaluation.RULES, ((0.3, 0.5, 0.95), (0.02, 0.0), (0.65, None), (None, 0.015, 0.03), (0, 3))))
    got = {tuple(r[x] for x in evaluation.RULES): tuple(r[c] for c in ("true_positive", "true_negative", "false_positive", "false_negative")) for r in evaluation.search_thresholds(df, values).collect()}
    want = {}
    for t in itertools.product(*values.values()):
        passes = lambda r: not any(a is not None and b is not None and a < b for a, b in zip((r[1], r[2], r[3] or 0.0, r[4] or 0.0, r[5]), t))  # noqa: B023, E731
        want[tuple(None if x is None else float(x) for x in t)] = tuple(sum(passes(r) == p and r[6] == e for r in rows) for e, p in ((True, True), (False, False), (False, True), (True, False)))
    assert got == want
    assert len(evaluation.search_thresholds(df.where("false"), values).collect()) == len(want)
    best = evaluation.best_thresholds(evaluation.search_thresholds(df, values), 1)
    limits = best.first()
    judged = evaluation.judge_thresholds(best, df.where("query_id < 30")).first()
    assert judged["total"] == 30 and all(judged[r] == limits[r] for r in evaluation.RULES)
