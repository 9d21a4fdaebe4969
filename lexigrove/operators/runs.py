"""A log of runs: one appended row for each change of a run's status, and what the log says of each run."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, kind string, name string, status string, at timestamp, message string"
#: The statuses of a run, and which may follow which.
STATUSES = ("created", "running", "completed", "failed")
FOLLOWS = {"created": (None,), "running": ("created",), "completed": ("running",), "failed": ("created", "running")}


def new_id(kind: str, name: str) -> str:
    """kind_name_ and eight hexadecimal digits, blanks as underscores."""
    return "_".join(["_".join(part.strip().lower().split()) for part in (kind, name)] + [uuid.uuid4().hex[:8]])


def note(spark: SparkSession, path: str, run_id: str, kind: str, name: str, status: str, message: str | None = None, at: datetime | None = None) -> None:
    """Appends a change of status."""
    if status not in STATUSES:
        raise ValueError(f"no status {status}; there are {', '.join(STATUSES)}")
    now = (at or datetime.now(timezone.utc)).astimezone(timezone.utc)
    spark.createDataFrame([(run_id, kind, name, status, now, message)], LOG).write.mode("append").parquet(path)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with microseconds, six digits after the point."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6), 6)


def states(log: DataFrame) -> DataFrame:
    """(run_id, kind, name, status, started_at, ended_at, duration_seconds, error, valid): one row for each run.

    A run's changes are few; they are put in order of time, those of one time in order of status. `valid` says that each
    may follow the one before. A run that has not ended has no duration; a failure's message is its error.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    all_of = F.array_sort(F.collect_list(F.struct(F.col("at").cast("timestamp").alias("at"), order.alias("order"), "status", "kind", "name", "message"))).alias("steps")
    runs = log.groupBy("run_id").agg(all_of)
    last = F.element_at("steps", -1)
    when = lambda *names: F.try_element_at(F.filter("steps", lambda s: s["status"].isin(*names)), F.lit(1))["at"]
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("steps", lambda s: s["status"]))
    allowed = lambda s, b: F.coalesce(*[F.when(s["status"] == k, F.coalesce(b.isin(*[x for x in v if x]), F.lit(False)) | (b.isNull() & F.lit(None in v))) for k, v in FOLLOWS.items()], F.lit(False))
    valid = F.forall(F.sequence(F.lit(1), F.size("steps")), lambda i: allowed(F.element_at("steps", i), F.element_at(before, i)))
    out = runs.select("run_id", last["kind"].alias("kind"), last["name"].alias("name"), last["status"].alias("status"), when("running").alias("started_at"), when("completed", "failed").alias("ended_at"),
                      F.when(last["status"] == "failed", last["message"]).alias("error"), valid.alias("valid"))
    return out.withColumn("duration_seconds", seconds_between(F.col("started_at"), F.col("ended_at")))
