"""The tree of shards splits by documents' metadata, not by their hashes."""

import pytest

from lexigrove.llm import sharding


@pytest.mark.parametrize(
    "at",
    [lambda i: ("en", f"src{i % 4}", 6), lambda i: (("de", "en", "es", "fr")[i % 4], None, 6), lambda i: (("de", "en")[i % 2], f"src{i // 2 % 2 + 10}", 6)],
)
def test_shards_part_sources_and_languages(spark, at):
    rows = []
    for i in range(400):
        lang, source, width = at(i)
        # texts of one width weigh alike, so that medians lie between the groups
        rows.append((i, f"{i:0{width}d}", lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shard = {r["id"]: r["shard"] for r in sharding.shard_documents(df, shards=4).collect()}
    groups = {}
    for i in range(400):
        groups.setdefault(at(i), set()).add(shard[i])
    assert sorted(x for g in groups.values() for x in g) == [0, 1, 2, 3] and all(len(g) == 1 for g in groups.values())
