"""The ingestion manifest as a merge of two snapshots, and checks between data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import evaluation_form, strip, text_of


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both (document_id, checksum): NEW, MODIFIED, UNCHANGED or MISSING for each document."""
    old = existing.select("document_id", F.col("checksum").alias("old"))
    both = incoming.select("document_id", F.col("checksum").alias("new")).join(old, "document_id", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return both.select("document_id", status.alias("status"), F.coalesce("new", "old").alias("checksum"))


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: restart without what a former run has finished."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def present(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_semi")


def alias_scan(aliases: DataFrame, texts: DataFrame) -> DataFrame:
    """aliases(technology, alias), texts(text_id, source, text): which technologies any text names, by whole words.

    Texts become word n-grams of the aliases' lengths, joined with aliases on equality: no pair is tested twice.
    """
    from lexigrove.functions.text import technology_form

    named = aliases.select("technology", technology_form(F.col("alias")).alias("form")).where("form <> ''").distinct()
    named = named.withColumn("n", F.size(F.split("form", " ")))
    lengths = named.groupBy().agg(F.collect_set("n").alias("lengths"))  # one row of small numbers
    words = texts.select("text_id", "source", F.split(technology_form(F.col("text")), " ").alias("w")).crossJoin(F.broadcast(lengths))
    grams = F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    seen = words.select("text_id", "source", F.explode(F.array_distinct(grams)).alias("form"))
    hits = seen.join(named, "form").groupBy("technology").agg(
        F.count_distinct("text_id").alias("matching"), F.array_join(F.array_sort(F.collect_set("form")), " | ").alias("matched"), F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, 5), " | ").alias("sources")
    )
    every = aliases.select("technology").distinct().join(hits, "technology", "left")
    return every.select("technology", F.coalesce("matching", F.lit(0)).alias("matching"), (F.col("matching").isNotNull()).alias("present"), F.coalesce("matched", F.lit("")).alias("matched"), F.coalesce("sources", F.lit("")).alias("sources"))


def dataset_rules(items: DataFrame, answerable: int = 30, unanswerable: int = 30) -> DataFrame:
    """items(id, question, answerable, expected_source, evidence) to (rule, failures): ids and compared questions that stand
    again, how far the two counts are off, answerable items without source or evidence, and others with either."""
    blank = lambda c: strip(text_of(c)) == ""
    can = F.coalesce("answerable", F.lit(False))
    form = items.select("*", evaluation_form("question").alias("form"))
    told = form.agg(
        (F.count("*") - F.count_distinct("id")).alias("unique_ids"), (F.count("*") - F.count_distinct("form")).alias("unique_questions"), F.count_if(F.col("form") == "").alias("filled_questions"),
        F.abs(F.count_if(can) - answerable).alias("answerable_count"), F.abs(F.count_if(~can) - unanswerable).alias("unanswerable_count"),
        F.count_if(can & (blank("expected_source") | blank("evidence"))).alias("answerable_has_evidence"), F.count_if(~can & ~(blank("expected_source") & blank("evidence"))).alias("unanswerable_has_none"),
    )
    return told.unpivot([], told.columns, "rule", "failures")


def file_checks(wanted: DataFrame, files: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """wanted(path), files(path, size) as a listing has them: (path, problem), in order of the lower-case path. A problem is
    `missing`, `unsupported` ending, `empty`, or null."""
    ending = F.concat(F.lit("."), F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1))
    held = wanted.select("path").join(files.select("path", "size"), "path", "left")
    endings = [f".{e.strip().lower().lstrip('.')}" for e in supported]
    problem = F.when(F.col("size").isNull(), "missing").when(~ending.isin(*endings), "unsupported").when(F.col("size") == 0, "empty")
    return held.select("path", problem.alias("problem")).orderBy(F.lower("path"), "path")
