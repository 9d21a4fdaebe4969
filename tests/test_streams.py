"""Streams, each with a time limit: NEW, UNCHANGED, MODIFIED, MISSING over batches; memory; first-seen rows; counts."""

import datetime as dt
import uuid

import pytest

from lexigrove.streaming import ingest
from lexigrove.streaming.manifest_log import ManifestLog

LIMIT = 120  # seconds


def ended(query):
    done = query.awaitTermination(LIMIT)
    if not done:
        query.stop()
    assert done, "the stream did not end"


def collected(stream, name, tmp_path, mode):
    """The rows that this run of the stream brings; the checkpoint is the name's."""
    out = str(tmp_path / f"out-{uuid.uuid4().hex}")
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    ended(writer.option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/*").collect()


def test_manifest_over_batches(spark, tmp_path):
    schema = "document_id string, checksum string, seen_at timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda n: dt.datetime(2024, 1, n)

    log = ManifestLog(spark, out)

    def status(version=None):
        return {r["document_id"]: (r["status"], r["checksum"]) for r in log.read(version).collect()}

    batches = (
        ([("a", "1", day(1)), ("b", "1", day(1))], {"a": ("new", "1"), "b": ("new", "1")}),
        ([("a", "1", day(2))], {"a": ("unchanged", "1"), "b": ("new", "1")}),
        ([("a", "9", day(3)), ("a", "2", day(4)), ("c", "1", day(3))], {"a": ("modified", "2"), "b": ("new", "1"), "c": ("new", "1")}),
        ([("a", "2", day(5))], {"a": ("unchanged", "2"), "b": ("new", "1"), "c": ("new", "1")}),
    )
    for rows, want in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        ended(ingest.merge_batches(spark.readStream.schema(schema).json(src), out, str(tmp_path / "ck")))
        assert status() == want
    log.mark_missing(spark.createDataFrame([("a",), ("c",)], "document_id string"))
    assert status() == {"a": ("unchanged", "2"), "b": ("missing", "1"), "c": ("new", "1")}
    # marks stay when the stream goes on, and a document that is there again is judged by its checksum
    spark.createDataFrame([("c", "5", day(6))], schema).coalesce(1).write.mode("append").json(src)
    ended(ingest.merge_batches(spark.readStream.schema(schema).json(src), out, str(tmp_path / "ck")))
    assert status() == {"a": ("unchanged", "2"), "b": ("missing", "1"), "c": ("modified", "5")}
    spark.createDataFrame([("b", "1", day(7))], schema).coalesce(1).write.mode("append").json(src)
    ended(ingest.merge_batches(spark.readStream.schema(schema).json(src), out, str(tmp_path / "ck")))
    assert status()["b"] == ("unchanged", "1") and status(5)["b"] == ("missing", "1")


@pytest.mark.parametrize("far", [False, True])
def test_memory(spark, tmp_path, far):
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    at = lambda n, d=1: dt.datetime(2024, 1, d, 0, n)
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, i, "user", f"m{i}", at(i)) for i in range(5)] + [(2, 0, "user", "x", at(0))], schema).coalesce(1).write.json(src)
    stream = lambda: ingest.remember(spark.readStream.schema(schema).json(src), last=2)
    first = collected(stream(), f"memory_{far}", tmp_path, "update")
    assert sorted((r["conv_id"], r["turn"]) for r in first) == [(1, 3), (1, 4), (2, 0)]
    if far:  # a day later conversation 1 has been forgotten
        spark.createDataFrame([(3, 0, "user", "y", at(0, 2))], schema).coalesce(1).write.mode("append").json(src)
        collected(stream(), "memory_True", tmp_path, "update")
    spark.createDataFrame([(1, 9, "user", "z", at(9, 2 if far else 1))], schema).coalesce(1).write.mode("append").json(src)
    again = collected(stream(), f"memory_{far}", tmp_path, "update")
    assert sorted((r["conv_id"], r["turn"]) for r in again if r["conv_id"] == 1) == ([(1, 9)] if far else [(1, 4), (1, 9)])


def test_first_seen_and_counts(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, at(0, 1), "a", 1.0), (1, at(0, 2), "a", 2.0), (2, at(0, 3), "b", 4.0), (3, at(9, 0), "a", 8.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    assert sorted(r["event_id"] for r in collected(ingest.first_seen(read(), "event_id", "ts"), "seen_rows", tmp_path, "append")) == [1, 2, 3]
    got = {(r["window"]["start"].hour, r["event_type"]): (r["events"], r["total"]) for r in collected(ingest.counted(read()), "counted_rows", tmp_path, "append")}
    assert got == {(0, "a"): (2, 3.0), (0, "b"): (1, 4.0)}
