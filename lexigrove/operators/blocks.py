"""Sections as typed blocks in order, and token windows over them that know which blocks they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions import text as X


def identity(prefix: str, *parts: Column) -> Column:
    """An id from the parts, null ones as empty: parts joined by bars, as a checksum."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def build_blocks(sections: DataFrame, id_col: str) -> DataFrame:
    """(id, block_index, block_id, section_id, heading, heading_path, block_type, text): heading, paragraphs, lists,
    tables and code of each section, in the document's order; blank ones take no index."""
    one = lambda kind, text: F.struct(F.lit(kind).alias("block_type"), text.alias("text"))
    row = lambda r: F.array_join(r, " | ")
    parts = F.concat(
        F.array(one("heading", X.text_of("heading"))), F.transform("paragraphs", lambda p: one("paragraph", p)), F.transform("lists", lambda x: one("list", F.array_join(x, "\n"))),
        F.transform("tables", lambda t: one("table", F.array_join(F.transform(F.concat(F.array(t["headers"]), t["rows"]), row), "\n"))), F.transform("code", lambda c: one("code", c["content"])),
    )
    flat = sections.select(id_col, F.concat_ws(":", F.col(id_col).cast("string"), "position").alias("section_id"), "position", "heading", "heading_path", F.posexplode(parts).alias("at", "b"))
    flat = flat.where(X.strip(F.col("b.text")) != "")
    at = F.row_number().over(Window.partitionBy(id_col).orderBy("position", "at")) - 1
    flat = flat.select(id_col, at.cast("long").alias("block_index"), "section_id", "heading", "heading_path", "b.block_type", X.strip(F.col("b.text")).alias("text"))
    return flat.withColumn("block_id", identity("block", F.col(id_col), F.col("block_type"), F.col("block_index"), F.col("section_id"), F.col("text")))


def common_prefix(paths: Column) -> Column:
    """The longest beginning that all paths share."""
    size = lambda a, b: F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))) - 1
    return F.aggregate(paths, F.element_at(paths, 1), lambda a, b: F.slice(a, F.lit(1), size(a, b)))


def chunk_blocks(blocks: DataFrame, id_col: str, size: int = 256, overlap: int = 32) -> DataFrame:
    """Token windows over a document's blocks: content, the blocks, types and headings covered, the section if it is
    one, and the heading path that all covered blocks share."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    tokens = X.tokens(F.col("text"))
    ends = F.sum(F.size("tok")).over(Window.partitionBy(id_col).orderBy("block_index"))
    laid = blocks.withColumn("tok", tokens).withColumn("end", ends)
    held = F.struct("block_index", (F.col("end") - F.size("tok")).alias("start"), "end", "block_id", "block_type", "section_id", "heading", "heading_path", "tok")
    docs = laid.groupBy(id_col).agg(F.array_sort(F.collect_list(held)).alias("b")).withColumn("tok", F.flatten(F.transform("b", lambda x: x["tok"])))
    n = F.size("tok")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0)).cast("int")), lambda i: i * (size - overlap))
    cut = docs.where(n > 0).select(id_col, "b", "tok", F.posexplode(starts).alias("chunk_index", "start"))
    cut = cut.withColumn("part", F.slice("tok", F.col("start") + 1, F.lit(size)))
    covered = F.filter("b", lambda x: (x["start"] < F.col("start") + F.size("part")) & (x["end"] > F.col("start")))
    cut = cut.withColumn("covered", F.transform(covered, lambda x: x.dropFields("tok")))
    of = lambda c: F.array_distinct(F.array_compact(F.transform("covered", lambda x: x[c])))
    out = cut.select(
        id_col, F.col("chunk_index").cast("long"), F.col("start").cast("long"), F.size("part").cast("long").alias("token_count"), F.array_join("part", " ").alias("content"), of("block_id").alias("block_ids"),
        of("block_type").alias("content_types"), of("section_id").alias("section_ids"), of("heading").alias("headings"), common_prefix(F.transform("covered", lambda x: x["heading_path"])).alias("heading_path"),
    )
    out = out.withColumn("section_id", F.when(F.size("section_ids") == 1, F.element_at("section_ids", 1)))
    return out.withColumn("chunk_id", identity("chunk", F.col(id_col), F.lit("fixed_size"), F.lit(size), F.lit(overlap), F.col("chunk_index"), F.col("content")))
