"""K-d tree partitioning of documents into shards of near-equal bytes.

Points are groups of equal texts, weighed by their bytes; the dimensions are the logarithm of the text's length, and
its source's and its language's places among all sources and languages in order. A node with several shards is split
at the weighted median of its widest dimension, in the ratio of the shards each side is to have, until every leaf has
one shard and so the target bytes. Widths are shares of the whole table's; a hash breaks ties within a dimension, and
is the dimension of nodes that are alike in all others.

A node's median is found without gathering rows: a histogram of weights over the dimension's sortable 64-bit key
(value, then a hash that breaks ties) names the cell in which the median lies; that cell is refined until it is
one key. All nodes of a level are split by the same jobs, and only the histograms' chosen cells reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import Scratch, documents, partitions, ranked

_META = ("length", "source", "lang")
_DIMS = (*_META, "hash")
_STEP = 12  # bits that one histogram settles
_TIE = 31  # low bits of a key: the hash that breaks ties


def _places(rows: DataFrame, scratch: Scratch, c: str) -> DataFrame:
    """(value, place from 1) of the distinct values of a column in order."""
    values = rows.select(F.col(c).alias(f"{c}_value")).where(F.col(c).isNotNull()).distinct()
    out = ranked(values, scratch, f"{c}-dealt", [], [f"{c}_value"], partitions(rows.sparkSession, 0, 1))
    return scratch.save(out.select(f"{c}_value", (F.col("rank") + 1).alias(f"{c}_place")), f"{c}-places")


def _keys(tie: Column) -> dict[str, Column]:
    """Each dimension as a key of 63 bits: 32 of value, 31 of the tie's hash."""
    scaled = {
        "length": F.least(F.log2(F.col("each").cast("double")) * F.lit(float(1 << 26)), F.lit(float((1 << 32) - 1))).cast("long"),
        "source": F.coalesce("source_place", F.lit(0)), "lang": F.coalesce("lang_place", F.lit(0)), "hash": F.shiftrightunsigned(F.col("h2"), 32),
    }
    return {k: F.shiftleft(v, _TIE).bitwiseOR(F.shiftrightunsigned(tie, 64 - _TIE)) for k, v in scaled.items()}


def split_tree(points: DataFrame, shards: int) -> list[Column]:
    """points: (one column for each dimension, weight). Returns each leaf as a condition on the dimensions."""
    nodes: list[tuple[Column, int]] = [(F.lit(True), shards)]  # a node's condition and the shards it is to have
    whole: dict[str, int] = {}  # each dimension's width at the root
    while any(n > 1 for _, n in nodes):
        split_here = [k for k, (_, n) in enumerate(nodes) if n > 1]
        at = points.withColumn("node", _which([(k, nodes[k][0]) for k in split_here])).where("node is not null")
        spread = at.groupBy("node").agg(F.sum("weight").alias("w"), *[f(F.shiftrightunsigned(d, _TIE)).alias(f"{n}_{d}") for d in _DIMS for n, f in (("lo", F.min), ("hi", F.max))])
        chosen = {}
        for r in spread.collect():  # one row for each node to split
            width = {d: r[f"hi_{d}"] - r[f"lo_{d}"] for d in _META}
            whole = whole or width
            dim = max(_META, key=lambda d: (width[d] / max(1, whole[d]), -_META.index(d))) if any(width.values()) else "hash"
            n = nodes[r["node"]][1]
            chosen[r["node"]] = {"dim": dim, "whole": r["w"], "goal": r["w"] * (n // 2) / n, "base": 0, "lo": 0}
        if not chosen:
            break  # an empty table
        for top in range(63, 0, -_STEP):
            low = max(0, top - _STEP)
            key = F.coalesce(*[F.when(F.col("node") == k, F.col(c["dim"]) - F.lit(c["lo"])) for k, c in chosen.items()])
            goal = F.coalesce(*[F.when(F.col("node") == k, F.lit(float(c["goal"] - c["base"]))) for k, c in chosen.items()])
            inside = at.select("node", "weight", key.alias("key"), goal.alias("goal")).where(f"key >= 0 and shiftrightunsigned(key, {top}) = 0")
            cells = inside.groupBy("node", "goal", F.shiftrightunsigned("key", low).alias("cell")).agg(F.sum("weight").alias("w"))
            run = F.sum("w").over(Window.partitionBy("node").orderBy("cell"))
            crossed = cells.withColumn("run", run).where("run >= goal").groupBy("node").agg(F.min(F.struct("cell", "run", "w")).alias("x"))
            for r in crossed.collect():  # one row for each node to split
                c = chosen[r["node"]]
                c["over"] = c["base"] + r["x"]["run"]
                c["base"] += r["x"]["run"] - r["x"]["w"]
                c["lo"] += r["x"]["cell"] << low
        after = []
        for k, (where, n) in enumerate(nodes):
            if k not in chosen:
                after.append((where, n))
                continue
            c = chosen[k]
            take = c["over"] - c["goal"] <= c["goal"] - c["base"]
            left = F.col(c["dim"]) <= F.lit(c["lo"] if take else c["lo"] - 1)
            # what the sides weigh settles how many shards each has, so a group heavier than a shard has one alone
            share = min(n - 1, max(1, round(n * (c["over"] if take else c["base"]) / c["whole"]))) if c["whole"] else n // 2
            after += [(where & left, share), (where & ~left, n - share)]
        nodes = after
    return [where for where, _ in nodes]


def _which(cases: list[tuple[int, Column]]) -> Column:
    out = F.when(cases[0][1], cases[0][0])
    for k, where in cases[1:]:
        out = out.when(where, k)
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", shards: int = 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row: the law is `bytes`.

    size is the text's UTF-8 bytes plus 1. Rows with equal texts are one point of the tree and share a shard, so
    shards are as equal as the heaviest text's copies allow; a group heavier than a shard has a shard to itself.
    Points stand by the smallest source and language among the copies. A slot is the row's place in its shard by
    id; texts themselves are never shuffled.

    Defined cases: a null text counts as the empty text, of size 1; null sources and languages sort first; null
    ids take the last slots; a repeated row has a slot of its own; an empty table gives an empty one; columns
    that are not named are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))
    rows = scratch.save(rows, "rows")
    points = rows.groupBy("h1", "h2").agg(F.sum("size").alias("weight"), F.max("size").alias("each"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    for c in ("source", "lang"):
        points = points.join(_places(rows, scratch, c), F.col(c) == F.col(f"{c}_value"), "left")
    points = scratch.save(points.select("h1", "h2", "weight", *[v.alias(k) for k, v in _keys(F.col("h1")).items()]), "points")
    leaves = split_tree(points, shards)
    placed = points.select("h1", "h2", _which(list(enumerate(leaves))).cast("int").alias("shard"))
    out = rows.join(placed, ["h1", "h2"]).select("id", "size", "text_crc32", "shard", "h1")
    out = ranked(out, scratch, "placed", ["shard"], ["id", "h1"], partitions(spark, rows.count(), 1_000_000))
    return out.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_shard_documents(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
