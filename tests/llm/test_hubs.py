"""Components around hubs, blocks by shingles, and scratch tables by owner."""

import random
import threading

import pytest

from lexigrove.llm import common, near_dedup
from tests.llm import brute


@pytest.mark.parametrize("hub", [100_000, 3])  # an ordinary join, and hot nodes apart
def test_components_around_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "_HUB", hub)
    rng = random.Random(hub)
    edges = [(7, i) for i in range(8, 600)] + [(i, i + 1000) for i in range(0, 600, 3)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)] + [(5000 + i, 5001 + i) for i in range(40)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "c").collect())
    ids = sorted({x for a, b in edges if a != b for x in (a, b)})
    want = brute.smallest_reachable(ids, [e for e in edges if e[0] != e[1]])
    assert got == want


def test_blocks_by_shingles(spark, monkeypatch):
    """Groups of near copies are settled in as many blocks as their sets need."""
    monkeypatch.setattr(near_dedup, "_BLOCK_SHINGLES", 300)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(120)] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.NearDedup()(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_scratch_by_owner(spark):
    """What one thread releases is its own."""
    since = len(common.Scratch.made())
    mine = common.Scratch(spark, "mine")
    table = mine.save(spark.range(3), "t")

    def other():
        common.Scratch(spark, "other").save(spark.range(2), "t")
        common.Scratch.release()

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert table.count() == 3
    common.Scratch.release(since)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        table.count()
