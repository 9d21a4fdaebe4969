"""The tree of shards against a plain one on a small table."""

import math
import random

from pyspark.sql import functions as F

from lexigrove.llm import sharding


def plain_tree(points, shards):
    """points {name: (length, source place, language place, weight)} -> groups of names, one for each leaf."""
    whole = None

    def split(names, n):
        nonlocal whole
        if n == 1:
            return [names]
        width = [max(points[x][d] for x in names) - min(points[x][d] for x in names) for d in range(3)]
        whole = whole or width
        dim = max(range(3), key=lambda d: (width[d] / max(1, whole[d]), -d))
        order = sorted(names, key=lambda x: points[x][dim])
        total = sum(points[x][3] for x in names)
        goal, sums = total * (n // 2) / n, 0
        before = 0
        for k, x in enumerate(order):
            sums += points[x][3]
            if sums >= goal:
                break
            before = sums
        take = sums - goal <= goal - before
        left = order[: k + 1] if take else order[:k]
        share = min(n - 1, max(1, round(n * (sums if take else before) / total)))
        return split(left, share) + split(order[len(left) :], n - share)

    return split(list(points), shards)


def test_leaves_are_those_of_a_plain_tree(spark):
    rng = random.Random(12)
    # lengths that all differ: no ties within the length, and no two documents alike in source and language
    lengths = rng.sample(range(10, 5000), 60)
    rows = [(i, f"{i:03d}".ljust(n, "x"), None, f"s{i:03d}") for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {}
    for r in sharding.shard_documents(df, shards=8).where(F.col("law") == "bytes").collect():
        got.setdefault(r["shard"], set()).add(r["id"])
    points = {i: (int(math.log2(len(t) + 1) * (1 << 26)), i + 1, 0, len(t) + 1) for i, t, _, _ in rows}
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, plain_tree(points, 8)))
