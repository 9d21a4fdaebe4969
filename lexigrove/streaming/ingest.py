"""Incremental ingestion, conversation memory, first-seen rows and windowed counts on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigrove.streaming.manifest_log import ManifestLog


def merge_batches(files: DataFrame, manifest_dir: str, checkpoint: str):
    """A stream of (document_id, checksum[, seen_at]) taken into the manifest log, batch by batch. Returns the started query.

    A batch is an increment: its documents become new, unchanged or modified, and no others change. A batch that runs
    again after a failure is known by the stream's checkpoint and its number, and changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        ManifestLog(batch.sparkSession, manifest_dir).evaluate(batch, checkpoint, number)

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remember(turns: DataFrame, last: int = 12, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The last messages of each conversation after every batch; a conversation idle for long is forgotten.

    turns has conv_id, turn, role, text and ts. State is bounded by `last` for each conversation, and a conversation
    ends when the watermark (`late` behind the newest ts) passes its newest message by `idle`.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *old, newest = state.get if state.exists else ([], [], [], 0)
        held = list(zip(*old))
        for pdf in frames:
            held = sorted(held + list(zip(pdf["turn"], pdf["role"], pdf["text"])))[-last:]
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
        state.update((*[list(x) for x in zip(*held)], newest))
        state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *m) for m in held], columns=["conv_id", "turn", "role", "text"])

    state = "turns array<long>, roles array<string>, texts array<string>, newest long"
    grouped = turns.withWatermark("ts", late).groupBy("conv_id")
    return grouped.applyInPandasWithState(update, "conv_id long, turn long, role string, text string", state, "update", GroupStateTimeout.EventTimeTimeout)


def first_seen(rows: DataFrame, key: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def counted(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their values by tumbling window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
