"""Turns from end to end: routes and rewrites, the ways an answer ends, and history from a stream's state."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.dialogue import GREETING_REPLY
from lexigrove.operators import conversation
from lexigrove.operators.prompts import REFUSALS

LIMIT = 120
TIDE = "What moves the tide?"


def planned(spark, rows, rewrites=None):
    turns = conversation.with_history(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, reply_language string"))
    told = spark.createDataFrame(rewrites, "conv_id string, turn long, output string") if rewrites else None
    return {(r["conv_id"], r["turn"]): r for r in conversation.plan(turns, told).collect()}


def test_routes_and_rewrites(spark):
    rows = [
        ("greeting", 0, "user", "bonjour", "auto"), ("followup", 0, "user", TIDE, None), ("followup", 1, "assistant", "An answer.", None), ("followup", 2, "user", "more of this", None),
        ("fr", 0, "user", "Qu'est-ce que la marée ?", "auto"), ("ar", 0, "user", "ما هو المد والجزر؟", "AUTO "), ("manual", 0, "user", TIDE, "fr"), ("odd", 0, "user", TIDE, "xx"),
        ("plain", 0, "user", TIDE, None), ("plain", 1, "assistant", "x", None), ("plain", 2, "user", "why?", None), ("long", 0, "user", "the first one", None), *[("long", i, "assistant", "x", None) for i in range(1, 14)], ("long", 14, "user", "why?", None), ("empty", 0, "user", None, None),
    ]
    rewrites = [("followup", 2, "Say more of what moves the tide."), ("fr", 0, f'"{TIDE}"'), ("ar", 0, TIDE), ("plain", 2, "Answer: it is"), ("manual", 0, "not asked for")]
    got = planned(spark, rows, rewrites)
    assert (got["greeting", 0]["intent"], got["greeting", 0]["question"], got["greeting", 0]["language"]) == ("GREETING", None, "fr")
    assert (got["followup", 2]["intent"], got["followup", 2]["rewritten"], got["followup", 2]["question"]) == ("FOLLOW_UP", *["Say more of what moves the tide."] * 2)
    assert [(got[k, 0]["reply_language"], got[k, 0]["rewritten"]) for k in ("fr", "ar")] == [("fr", TIDE), ("ar", TIDE)]
    assert (got["manual", 0]["reply_language"], got["manual", 0]["rewritten"], got["manual", 0]["question"]) == ("fr", None, TIDE) and got["odd", 0]["reply_language"] == "en"
    assert got["plain", 2]["question"] == f"Regarding '{TIDE}': why?"  # the model's output was an answer
    assert got["long", 14]["question"] == "why?"  # the user's last message has been forgotten
    assert (got["empty", 0]["intent"], got["empty", 0]["question"]) == ("KNOWLEDGE_QUERY", "")
    assert len(got) == 12  # the user.s messages only


def test_ways_to_end(spark):
    kinds = ("greet", "rejected", "unknown", "off", "failed", "bad", "bare", "good")
    rows = [(k, 0, "user", "hello" if k == "greet" else "Quel est le courant, ça ?" if k == "bad" else TIDE) for k in kinds]
    plan = conversation.plan(conversation.with_history(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")))
    gated = spark.createDataFrame([(f"{k}:0", k != "rejected", "margin" if k == "rejected" else "") for k in kinds if k not in ("greet", "unknown")], "query_id string, accepted boolean, failed_rules string")
    allowed = spark.createDataFrame([(f"{k}:0", ["[a.md:1]"]) for k in kinds], "query_id string, allowed array<string>")
    answers = {"bad": "It is [b.md:2]", "bare": "It is", "good": "It is [source: a.md:1]", "failed": None, "rejected": "x [a.md:1]", "off": "x [a.md:1]"}
    given = spark.createDataFrame([(f"{k}:0", v) for k, v in answers.items()], "query_id string, answer string")
    got = {r["conv_id"]: r for r in conversation.respond(plan, gated, allowed, given, F.col("conv_id") != "off").collect()}
    assert {k: (r["status"], r["outcome"]) for k, r in got.items()} == {
        "greet": ("greeting", None), "rejected": ("rejected", None), "unknown": ("rejected", None), "off": ("generation_disabled", None), "failed": ("generation_failed", None),
        "bad": ("invalid_citations", "unauthorized_citation"), "bare": ("invalid_citations", "no_citation"), "good": ("accepted", "valid"),
    }
    assert got["greet"]["answer"] == GREETING_REPLY["en"] and got["bad"]["answer"] == REFUSALS["fr"] and got["rejected"]["answer"] == REFUSALS["en"] and got["off"]["answer"] == conversation.DISABLED
    assert got["good"]["answer"] == answers["good"] and got["rejected"]["failed_rules"] == "margin"
    kept = [(r["turn"], r["role"], r["text"]) for r in conversation.remembered(conversation.respond(plan, gated, allowed, given)).where("conv_id = 'good'").orderBy("turn").collect()]
    assert kept == [(0, "user", TIDE), (1, "assistant", answers["good"])]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_history_from_state(spark, rocks, tmp_path):
    """Over batches, a stream's history is a table's, until a conversation has been idle for long."""
    shape = "conv_id long, turn long, role string, text string, ts timestamp"
    at = lambda n, day=1: dt.datetime(2024, 1, day, 0, n % 60)
    message = lambda c, t, day=1: (c, t, "user" if t % 2 == 0 else "assistant", f"m{t}", at(t, day))
    batches = [[message(1, t) for t in (2, 0, 1)] + [message(2, 0)], [message(1, t) for t in range(3, 20)], [message(3, 0, 2)], [message(1, 20, 2), message(3, 1, 2)]]
    out = f"{tmp_path}/out"
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = conversation.history_stream(spark.readStream.schema(shape).json(f"{tmp_path}/in"))
        write = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={uuid.uuid4().hex}")
        query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        done = query.awaitTermination(LIMIT)
        if not done:
            query.stop()
        assert done, "the stream did not end"
    columns = ["conv_id", "turn", "has_history", "last_user", "context"]
    got = {(r[0], r[1]): tuple(r)[2:] for r in spark.read.parquet(out).select(*columns).collect()}
    table = spark.createDataFrame([r for rows in batches for r in rows], shape)
    want = {(r[0], r[1]): tuple(r)[2:] for r in conversation.with_history(table).select(*columns).collect()}
    want[1, 20] = (False, None, "")  # a day later conversation 1 had been dropped
    assert got == want
