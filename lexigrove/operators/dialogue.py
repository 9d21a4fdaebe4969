"""Conversation turns: language, intent, the window of history, a rewrite without a model, answers and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions import citations, dialogue
from lexigrove.functions.text import strip, text_of


def _before() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)


def routed(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text): language, confidence, follow-up and intent of each."""
    history = F.count("*").over(_before()) > 0
    lang = dialogue.language(F.col("text"))
    out = turns.withColumns({"has_history": history, "lang": lang})
    return out.select("conv_id", "turn", F.col("lang.language").alias("language"), F.col("lang.confidence").alias("confidence"), "has_history",
                      dialogue.is_follow_up(F.col("text"), F.col("has_history")).alias("follow_up"), dialogue.intent(F.col("text"), F.col("has_history")).alias("intent"))


def recent(turns: DataFrame, last: int = 12) -> DataFrame:
    """The last messages of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", back.cast("long")).where(F.col("back") <= last)


def context(turns: DataFrame, messages: int = 4, characters: int = 4000) -> DataFrame:
    """For each turn, the last messages before it as text, cut to the last characters."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-messages, -1)
    lines = F.collect_list(F.concat(F.col("role"), F.lit(": "), text_of("text"))).over(w)
    return turns.select("conv_id", "turn", F.right(F.array_join(lines, "\n"), F.lit(characters)).alias("context"))


def rewritten(turns: DataFrame) -> DataFrame:
    """The question with the last user message before it, where it depends on that; else the question itself."""
    last = F.last(F.when(F.col("role") == "user", F.col("text")), True).over(_before())
    history = F.count("*").over(_before()) > 0
    out = turns.withColumns({"last_user": last, "follow": dialogue.is_follow_up(F.col("text"), history)})
    query = F.when(F.col("follow") & F.col("last_user").isNotNull(), F.concat(F.lit("Regarding '"), "last_user", F.lit("': "), text_of("text"))).otherwise(text_of("text"))
    return out.select("conv_id", "turn", "last_user", query.alias("query"))


def citation_id(source: Column, chunk: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit(":"), chunk, F.lit("]"))


def prompts(contexts: DataFrame, top: int = 2) -> DataFrame:
    """contexts(query_id, rank, source, chunk_id, content) to one prompt body for each query."""
    block = F.concat(F.lit("Source "), citation_id(F.col("source"), F.col("chunk_id").cast("string")), F.lit("\n"), "content")
    kept = contexts.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("all"))
    return kept.select("query_id", F.array_join(F.transform("all", lambda x: x["block"]), "\n\n").alias("context"))


def excerpts(contexts: DataFrame) -> DataFrame:
    """The answer without a model: the first context's beginning, and its citation."""
    answer = F.concat(strip(F.substring("content", 1, 300)), F.lit(" "), citation_id(F.col("source"), F.col("chunk_id").cast("string")))
    return contexts.where("rank = 1").select("query_id", answer.alias("answer"))


def answers(features_gate: DataFrame, contexts: DataFrame, top: int = 2) -> DataFrame:
    """(query_id, status, answer): rejected by the gate, or answered and held against the citations allowed."""
    allowed = contexts.where(F.col("rank") <= top).groupBy("query_id").agg(F.collect_set(citation_id(F.col("source"), F.col("chunk_id").cast("string"))).alias("allowed"))
    joined = features_gate.join(excerpts(contexts), "query_id", "left").join(allowed, "query_id", "left")
    none = F.array().cast("array<string>")
    verdict = citations.verdict(F.col("answer"), F.coalesce("allowed", none))
    joined = joined.withColumn("verdict", verdict)
    status = F.when(~F.col("accepted"), "rejected").when(~F.col("verdict.valid"), "invalid_citations").otherwise("accepted")
    return joined.select("query_id", status.alias("status"), F.when(status == "accepted", F.col("answer")).alias("answer"))
