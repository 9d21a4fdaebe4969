"""Turns of conversations from end to end: history, route, rewrite, retrieval and one of the ways an answer ends.

History comes from a window over a table of messages or, on a stream, from state that holds the last messages of each
conversation and is dropped by a timer. What follows is the same for both: `plan` routes and rewrites, any retrieval
answers the planned questions, and `respond` says how each turn ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lexigrove.functions import citations, dialogue
from lexigrove.functions.queries import normalised_output
from lexigrove.functions.text import strip, text_of
from lexigrove.operators.prompts import REFUSALS

LAST, CONTEXT, CHARACTERS = 12, 4, 4000
_ADDED = "has_history boolean, last_user string, context string"
DISABLED = "The sources answer this question, but no answers are generated at present."


def with_history(messages: DataFrame, last: int = LAST, context: int = CONTEXT, characters: int = CHARACTERS) -> DataFrame:
    """messages(conv_id, turn, role, text, ...) with what each knows of the `last` messages before it: whether there are
    any, the last one of the user, and the end of the last few as text."""
    before = lambda n: Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    lines = F.collect_list(F.concat(F.coalesce("role", F.lit("")), F.lit(": "), text_of("text"))).over(before(context))
    return messages.withColumns(
        {
            "has_history": F.count(F.lit(1)).over(before(last)) > 0, "last_user": F.last(F.when(F.col("role") == "user", text_of("text")), True).over(before(last)),
            "context": F.right(F.array_join(lines, "\n"), F.lit(characters)),
        }
    )


class _Memory(StatefulProcessor):
    """The last messages of a conversation as list state; a timer set from its newest message drops it."""

    def __init__(self, last: int, context: int, characters: int, idle_ms: int):
        self.last, self.context, self.characters, self.idle_ms = last, context, characters, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn long, role string, text string")
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        newest = self.newest.get()[0] if self.newest.exists() else 0
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")  # a conversation's messages of one batch
        told = []
        for turn, role, text in zip(new["turn"], new["role"], new["text"]):
            users = [t for _, r, t in held if r == "user"]
            lines = "\n".join(f"{r or ''}: {t}" for _, r, t in held[-self.context :])
            told.append((bool(held), users[-1] if users else None, lines[-self.characters :]))
            held = [*held, (int(turn), role, text or "")][-self.last :]
        self.messages.put(held)
        newest = max(newest, int(new["ts"].max().timestamp() * 1000))
        for at in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(at)
        self.newest.update((newest,))
        self.handle.registerTimer(max(newest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        added = pd.DataFrame(told, columns=[c.split()[0] for c in _ADDED.split(", ")], index=new.index)
        yield pd.concat([new, added], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def history_stream(messages: DataFrame, idle: str = "1 hour", late: str = "10 minutes", last: int = LAST, context: int = CONTEXT, characters: int = CHARACTERS) -> DataFrame:
    """`with_history` on a stream of messages(conv_id, turn, role, text, ts, ...), appended as they come.

    State holds `last` messages for each conversation and goes when the watermark (`late` behind the newest ts) passes a
    conversation's newest message by `idle`. The session needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). Answers come back into the stream as messages.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    shape = StructType([*messages.schema.fields, *StructType.fromDDL(_ADDED)])
    return messages.withWatermark("ts", late).groupBy("conv_id").transformWithStateInPandas(_Memory(last, context, characters, idle_ms), shape, "Append", "EventTime")


def plan(history: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """Messages of users with their history to (conv_id, turn, query_id, original, language, reply_language, intent, question,
    rewritten).

    A greeting asks nothing. A follow-up, or a message that is not in English, takes a model's rewrite, where rewrites
    (conv_id, turn, output) has one that is a question; a follow-up without one names the user's last message. Replies
    are in the language detected, unless a column reply_language asks for another of en, fr, ar.
    """
    asked = history.where("role = 'user'")
    wish = F.lower(strip(F.coalesce("reply_language", F.lit("auto")))) if "reply_language" in history.columns else F.lit("auto")
    if rewrites is not None:
        asked = asked.join(rewrites.select("conv_id", "turn", "output"), ["conv_id", "turn"], "left")
    else:
        asked = asked.withColumn("output", F.lit(None).cast("string"))
    asked = asked.withColumn("original", strip(text_of("text")))
    asked = asked.withColumns({"language": dialogue.language(F.col("original"))["language"], "intent": dialogue.intent(F.col("original"), F.col("has_history")), "wish": wish})
    greeting, follow = F.col("intent") == "GREETING", F.col("intent") == "FOLLOW_UP"
    asked = asked.withColumn("rewrite", F.when(~greeting & (follow | (F.col("language") != "en")), normalised_output(F.col("output"), F.col("original"))))
    named = F.concat(F.lit("Regarding '"), "last_user", F.lit("': "), "original")
    question = F.when(greeting, None).when(F.col("rewrite") != F.col("original"), F.col("rewrite")).when(follow & (F.coalesce("last_user", F.lit("")) != ""), named).otherwise(F.col("original"))
    return asked.select(
        "conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("query_id"), "original", "language", F.when(F.col("wish").isin("en", "fr", "ar"), F.col("wish")).otherwise(F.col("language")).alias("reply_language"), "intent",
        question.alias("question"), F.when(~greeting & (follow | (F.col("language") != "en")), question).alias("rewritten"),
    )


def _refusal(language: Column) -> Column:
    return F.when(language == "fr", REFUSALS["fr"]).when(language == "ar", REFUSALS["ar"]).otherwise(REFUSALS["en"])


def respond(planned: DataFrame, gated: DataFrame, allowed: DataFrame, generated: DataFrame, enabled: Column | None = None) -> DataFrame:
    """planned with status, answer, failed_rules and outcome: how each turn ends.

    gated(query_id, accepted, failed_rules); allowed(query_id, allowed), the citations of a question's contexts;
    generated(query_id, answer), null where every provider failed. A greeting is greeted. A question that the gate turns
    down, or that it has nothing on, is `rejected`. With generation off it is `generation_disabled`. Without an answer it
    is `generation_failed`, with one that cites what it may not it has `invalid_citations`, else it is `accepted`. All
    that are not answered are refused in the language of the reply.
    """
    none = F.array().cast("array<string>")
    held = planned.join(gated, "query_id", "left").join(allowed, "query_id", "left").join(generated.select("query_id", F.col("answer").alias("given")), "query_id", "left")
    held = held.withColumns({"on": F.lit(True) if enabled is None else enabled, "verdict": citations.verdict(F.col("given"), F.coalesce("allowed", none))})
    status = (
        F.when(F.col("intent") == "GREETING", "greeting").when(~F.coalesce("accepted", F.lit(False)), "rejected").when(~F.col("on"), "generation_disabled")
        .when(strip(text_of("given")) == "", "generation_failed").when(~F.col("verdict.valid"), "invalid_citations").otherwise("accepted")
    )
    held = held.withColumn("status", status)
    language = F.col("reply_language")
    answer = F.when(F.col("status") == "greeting", dialogue.greeting_reply(language)).when(F.col("status") == "accepted", F.col("given")).when(F.col("status") == "generation_disabled", DISABLED).otherwise(_refusal(language))
    judged = F.col("status").isin("invalid_citations", "accepted")
    return held.select(*planned.columns, "status", answer.alias("answer"), "failed_rules", F.when(judged, F.col("verdict.outcome")).alias("outcome"))


def remembered(responses: DataFrame) -> DataFrame:
    """The two messages that a turn leaves: (conv_id, turn, role, text), the answer half a turn later."""
    said = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.lit("user").alias("role"), F.col("original").alias("text")), F.struct(F.lit(1).alias("half"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))))
    return responses.select("conv_id", F.col("turn").alias("of"), said.alias("m")).select("conv_id", (F.col("of") * 2 + F.col("m.half")).alias("turn"), "m.role", "m.text")
