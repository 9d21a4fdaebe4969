"""Cleaning of documents as rows of paragraphs, with reports of what was removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions import text as X


def to_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line): the text's lines."""
    return docs.select(id_col, F.posexplode(F.split(X.text_of(text_col), "\n")).alias("pos", "line"))


def drop_boilerplate(lines: DataFrame) -> DataFrame:
    return lines.where(~X.is_boilerplate(F.col("line")))


def drop_repeats(lines: DataFrame, id_col: str = "doc_id", within: int | None = None) -> DataFrame:
    """The first of equal lines in a document, or in each run of `within` lines; blank lines all stay."""
    marked = lines.withColumn("form", X.dedup_form(F.col("line"))).withColumn("fp", X.fingerprint_of(F.col("form"))).drop("form")
    scope = [id_col, "fp"] + ([F.floor(F.col("pos") / within)] if within else [])
    nth = F.row_number().over(Window.partitionBy(*scope).orderBy("pos"))
    return marked.withColumn("nth", nth).where((F.col("nth") == 1) | (F.col("fp") == "")).drop("nth", "fp")


def drop_neighbours(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines unlike the one just before."""
    before = F.lag("line").over(Window.partitionBy(id_col).orderBy("pos"))
    return lines.withColumn("before", before).where(~F.col("line").eqNullSafe(F.col("before"))).drop("before")


def join_lines(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The smallest id of documents with one fingerprint, and how many there are."""
    formed = docs.select(id_col, X.dedup_form(F.col("text")).alias("form"))
    return formed.select(id_col, X.fingerprint_of(F.col("form")).alias("fp")).groupBy("fp").agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents, lines and characters in and out, lines removed by each step. Each document's lines are judged
    where they are read; a line's repeats are found by sorting the document's forms."""
    line = lambda x: F.struct(F.length(x).alias("chars"), X.is_boilerplate(x).alias("boiler"), X.dedup_form(x).alias("form"))
    lines = X.once(F.transform(F.split(X.text_of(text_col), "\n"), X.clean_inline), lambda ls: F.transform(ls, line))
    total = lambda ls, of: F.aggregate(ls, F.lit(0).cast("long"), lambda s, x: s + of(x).cast("long"))
    left = lambda ls: F.sort_array(F.transform(F.filter(ls, lambda x: ~x["boiler"]), lambda x, i: F.struct(x["form"].alias("form"), i.alias("i"), x["chars"].alias("chars"))))
    first = lambda s: F.filter(s, lambda x, k: (x["form"] == "") | (k == 0) | (F.get(s, k - 1)["form"] != x["form"]))
    told = docs.select(X.once(lines, lambda ls: F.struct(
        F.size(ls).alias("lines_in"), total(ls, lambda x: x["boiler"]).alias("boilerplate_removed"), total(ls, lambda x: x["chars"]).alias("characters_in"),
        X.once(left(ls), lambda s: X.once(first(s), lambda kept: F.struct(F.size(kept).alias("n"), total(kept, lambda x: x["chars"]).alias("chars")))).alias("kept"),
    )).alias("r"))
    gone = F.col("r.lines_in") - F.col("r.boilerplate_removed") - F.col("r.kept.n")
    return told.agg(
        F.count("*").alias("documents"), F.sum("r.lines_in").alias("lines_in"), F.sum("r.kept.n").alias("lines_out"), F.sum("r.boilerplate_removed").alias("boilerplate_removed"),
        F.sum(gone).alias("repeats_removed"), F.sum("r.characters_in").alias("characters_in"), F.sum("r.kept.chars").alias("characters_out"),
    )


def section_fingerprints(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One checksum for each document's lines, in order, however they are cased and spaced."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    forms = F.transform(ordered, lambda x: X.dedup_form(x["line"]))
    return lines.groupBy(id_col).agg(F.sha2(F.array_join(forms, "␞"), 256).alias("fingerprint"))
