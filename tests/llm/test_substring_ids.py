"""Substring dedup where ids are missing or repeated: each text loses its own words only."""

import pytest

from lexigrove.llm import substring_dedup
from tests.llm import brute


@pytest.mark.parametrize("crowd", [1000, 1])
def test_texts_without_an_id_of_their_own(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "_CROWD", crowd)
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    p = words("p", 40)
    rows = [(1, f"{p} {words('a', 30)}"), (None, f"{words('b', 5)} {p}"), (None, words("c", 60)), (None, f"{p} x"), (5, words("d", 50)), (5, f"{p} {words('e', 30)}"), (5, words("d", 50))]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "text").collect()
    # documents of their own; the row repeated as it is keeps what the first keeps
    apart = brute.substrings([(i, t) for i, (_, t) in enumerate(rows[:-1])])
    want = [(rows[i][0], *rest) for i, *rest in apart]
    want.append(want[4])
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
