"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words: its weight's share of `total` times all words, no more than `most` times its
own words, what exceeds that being shared anew by weight. A document's expected copies are its source's target
over its source's words. The copies' prefix sum along the source, plus one random offset for the source, crosses
integers; a document is taken once for each integer crossed in its interval. Within a source, documents stand by
size, so that a long one is never taken in place of many short ones, and by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import Scratch, documents, join_hot, partitions, ranked


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float, scratch: Scratch) -> DataFrame:
    """sizes: one row (source, source_size, rows) for each source. Adds `target`.

    Sources by code point, null last, take the weights in turn. The level that all open sources share by weight rises
    as sources reach their limit and close; each round is one aggregation over the sources, until none closes.
    """
    placed = ranked(sizes, scratch, "sources", [], ["source"], partitions(sizes.sparkSession, 0, 1))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    weighed = scratch.save(placed.withColumn("w", weight).withColumns({"cap": cap, "fill": cap / F.col("w")}), "weighed")
    level, closed = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("fill") < F.lit(level)
        got = weighed.agg(
            F.sum("source_size").alias("all"), F.count_if(full).alias("closed"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")
        ).first()
        if not got["open"] or got["closed"] == closed:
            break
        level, closed = (got["all"] * float(total) - got["given"]) / got["open"], got["closed"]
    target = F.col("cap") if not got["open"] else F.least("cap", F.lit(level) * F.col("w"))
    return weighed.select("source", "source_size", "rows", target.alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), total: float = 1.5, most: float = 2.0, seed: int = 17, key_col: str | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each document; with key_col, its key too.

    Only ids, sources and sizes are shuffled. Places within a source come from a range partitioning and one count
    for each partition, so no source is one task's work. The offset is a hash of source and seed: reruns agree.

    Defined cases: null text and text of white space have size 0 and are taken by the same rule, adding nothing; a
    text of any length is one row; a null source is a source of its own and stands last; documents of one size stand
    by id, a null id last, and rows alike in source, size and id are interchangeable; repeated rows each have their
    own place; a source without words has target 0 and no copies; an empty table gives an empty one; columns that
    are not named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = [F.col(key_col).alias("key")] if key_col else []
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *key)
    sized = scratch.save(sized, "sizes")
    per_source = scratch.save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, total, most, scratch), "targets")
    placed = ranked(sized, scratch, "placed", ["source"], ["size", "id"], partitions(docs.sparkSession, per_source.agg(F.sum("rows")).first()[0] or 0, 1_000_000))
    named = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("of")
    out = join_hot(placed.select("*", named), per_source.select(named, "source_size", "rows", "target"), ["of"], "rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("source").isNull(), "/null/").otherwise("/"), F.lit(str(seed)))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.floor((F.col("rank") + 1) * rate + offset) - F.floor(F.col("rank") * rate + offset)
    return out.select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *(["key"] if key_col else []))


def take_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns unchanged, whatever their names.

    Rows are written once with a key of their own, and only those that are taken travel.
    """
    scratch = Scratch(docs.sparkSession, "taken")
    held = scratch.save(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "rows")
    sized = held.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source"), "key")
    taken = mix_sources(sized, "id", "text", "source", key_col="key", **settings).where("copies > 0").select("key", "copies")
    out = held.join(taken, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = {
    "op4_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM src),
filled AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS fill, sum(source_size) OVER () AS whole FROM weighed),
leveled AS (
  SELECT *, (whole * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
aimed AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM leveled WHERE level <= fill) * w, cap)) AS target FROM leveled),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS place FROM sized),
rated AS (
  SELECT p.doc_id, p.size, a.source_size, a.target, p.place,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(coalesce(p.source, '') || CASE WHEN p.source IS NULL THEN '/null/' ELSE '/' END || '17'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (size * (floor((place + 1) * rate + u) - floor(place * rate + u)))::BIGINT AS taken FROM rated"""
}
