"""Duplicates among the parts of documents: paragraphs, list items, table rows, code blocks and links as rows of their own
in the order of the document, the first of each form kept within a section, a document or all documents, and sections
put together again from what is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions import text as X

KINDS = ("paragraphs", "list_items", "table_rows", "code_blocks", "links")
SCOPES = ("section", "document", "corpus")


def part_rows(sections: DataFrame, id_col: str) -> DataFrame:
    """(id, position, kind, outer, place, form): outer is the list or table that an item or row is in. A form is what parts
    are compared by: lower case, single spaces; empty where there is nothing to compare."""
    key = [id_col, "position"]
    form = X.dedup_form

    def flat(kind: str, column: str, of) -> DataFrame:
        rows = sections.select(*key, F.posexplode(column).alias("place", "v"))
        return rows.select(*key, F.lit(kind).alias("kind"), F.lit(0).alias("outer"), "place", of(F.col("v")).alias("form"))

    def nested(kind: str, column: str, inner, of) -> DataFrame:
        rows = sections.select(*key, F.posexplode(column).alias("outer", "one")).select(*key, "outer", F.posexplode(inner(F.col("one"))).alias("place", "v"))
        return rows.select(*key, F.lit(kind).alias("kind"), "outer", "place", of(F.col("v")).alias("form"))

    return reduce(DataFrame.unionByName, [
        flat("paragraphs", "paragraphs", form), nested("list_items", "lists", lambda one: one, form),
        nested("table_rows", "tables", lambda t: t["rows"], lambda r: F.array_join(F.transform(r, form), "␟")),  # a row of blanks has a form too
        flat("code_blocks", "code", lambda c: form(F.concat_ws("\n", F.coalesce(c["language"], F.lit("")), c["content"]))),
        flat("links", "links", lambda a: form(F.concat_ws("\n", F.coalesce(a["text"], F.lit("")), F.coalesce(a["url"], F.lit(""))))),
    ])


def marked(sections: DataFrame, id_col: str, scope: str = "document") -> DataFrame:
    """part_rows with `keep`: whether a part is the first of its form and kind in its section, its document or all documents.
    Forms are compared as digests. Copies of one form across all documents are counted down to a first one by a minimum,
    so that a form of a third of all parts is nobody's window."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    rows = part_rows(sections, id_col).withColumn("digest", F.sha2("form", 256)).withColumn("bare", (F.col("form") == "") & (F.col("kind") != "table_rows")).drop("form")
    order = ["position", "outer", "place"]
    if scope != "corpus":
        within = Window.partitionBy(id_col, *(["position"] if scope == "section" else []), "kind", "digest").orderBy(*order)
        return rows.withColumn("keep", (F.row_number().over(within) == 1) | F.col("bare")).drop("digest", "bare")
    first = rows.groupBy("kind", "digest").agg(F.min(F.struct(id_col, *order)).alias("first"))
    return rows.join(first, ["kind", "digest"]).withColumn("keep", (F.struct(id_col, *order) == F.col("first")) | F.col("bare")).drop("digest", "bare", "first")


def drop_repeated_parts(sections: DataFrame, id_col: str, scope: str = "document") -> DataFrame:
    """Sections with the parts kept, in their order, and `removed`: how many of each kind went. Lists left empty go."""
    parts = marked(sections, id_col, scope)
    one = parts.groupBy(id_col, "position", "kind", "outer").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "keep"))), lambda x: x["keep"]).alias("keep"), F.count_if(~F.col("keep")).alias("gone"))  # of a section
    all_ = one.groupBy(id_col, "position", "kind").agg(F.map_from_entries(F.collect_list(F.struct("outer", "keep"))).alias("masks"), F.sum("gone").alias("gone"))
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    mask = lambda kind: F.any_value(F.when(F.col("kind") == kind, F.col("masks")), ignoreNulls=True)
    wide = all_.groupBy(id_col, "position").agg(*[mask(k).alias(f"mask_{k}") for k in KINDS], F.struct(*[F.coalesce(at(k, "gone"), F.lit(0)).alias(k) for k in KINDS]).alias("removed"))
    chosen = lambda values, keep: F.when(keep.isNull(), values).otherwise(F.transform(F.filter(F.arrays_zip(values.alias("v"), keep.alias("k")), lambda z: z["k"]), lambda z: z["v"]))
    of = lambda kind, outer: F.try_element_at(f"mask_{kind}", outer)
    joined = sections.join(wide, [id_col, "position"], "left")
    lists = F.transform("lists", lambda one, i: chosen(one, of("list_items", i)))
    tables = F.transform("tables", lambda t, i: F.struct(t["headers"].alias("headers"), chosen(t["rows"], of("table_rows", i)).alias("rows")))
    out = joined.withColumns(
        {
            "paragraphs": chosen(F.col("paragraphs"), of("paragraphs", F.lit(0))), "lists": F.filter(lists, lambda one: F.size(one) > 0), "tables": tables,
            "code": chosen(F.col("code"), of("code_blocks", F.lit(0))), "links": chosen(F.col("links"), of("links", F.lit(0))),
        }
    )
    none = F.struct(*[F.lit(0).cast("long").alias(k) for k in KINDS])
    return out.withColumn("removed", F.coalesce("removed", none)).select(*sections.columns, "removed")
