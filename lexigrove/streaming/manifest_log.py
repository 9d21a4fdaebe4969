"""The ingestion manifest as a log of changes with snapshots.

A folder holds `log/N.json`, one small file for each version, `data/` with the rows that a version changed, and
`snapshots/N.json` with the whole state as of a version. A version is taken by creating its file, which only one
writer can do; a writer that comes second works its change out anew against the state that is there. Each version
names the stream and batch it comes from, so that a batch that runs again changes nothing. Compaction writes a
snapshot and deletes what it makes needless; readers take the newest snapshot and the versions after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.sources.shared import filesystem

STATE = "document_id string, status string, checksum string, error_message string"
_ROWS = STATE + ", deleted boolean"
_COMPACT = 20  # versions after a snapshot that lead to the next one


class ManifestLog:
    """The manifest in a folder that driver and executors share; made by its first change."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = _COMPACT):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after

    # --- files

    def _numbers(self, kind: str) -> list[int]:
        fs, folder = filesystem(self.spark, f"{self.path}/{kind}")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _told(self, kind: str, numbers: list[int]) -> dict[int, dict]:
        """The small files of these numbers, read by one job."""
        if not numbers:
            return {}
        files = self.spark.read.text([f"{self.path}/{kind}/{n:012d}.json" for n in numbers], wholetext=True)
        return {x["version"]: x for x in (json.loads(r["value"]) for r in files.collect())}  # as many as compaction leaves

    def _take(self, kind: str, number: int, told: dict) -> bool:
        """Creates a file that must not be there; False if another writer was first."""
        fs, file = filesystem(self.spark, f"{self.path}/{kind}/{number:012d}.json")
        if fs.exists(file):
            return False
        try:
            out = fs.create(file, False)
        except Exception as e:
            if fs.exists(file):
                return False
            raise e
        out.write(json.dumps(told | {"version": number}).encode())
        out.close()
        return True

    def _rows(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    # --- reading

    def version(self) -> int:
        return max([0, *self._numbers("log"), *self._numbers("snapshots")])

    def _base(self, upto: int) -> tuple[dict, list[dict]]:
        snapshots = [n for n in self._numbers("snapshots") if n <= upto]
        base = self._told("snapshots", snapshots[-1:]).get(snapshots[-1], {}) if snapshots else {}
        first = base.get("version", 0)
        log = self._told("log", [n for n in self._numbers("log") if first < n <= upto])
        if sorted(log) != list(range(first + 1, upto + 1)):
            raise ValueError(f"version {upto} can no longer be read: the log before it has been compacted")
        return base, [log[n] for n in sorted(log)]

    def read(self, version: int | None = None) -> DataFrame:
        """(document_id, status, checksum, error_message) as of a version, or now."""
        return self._state(*self._base(self.version() if version is None else version))

    def _state(self, base: dict, log: list[dict]) -> DataFrame:
        known = self._rows([base["data"]] if base else [], STATE).select(F.lit(0).alias("n"), "*", F.lit(False).alias("deleted"))
        for i, entry in enumerate(log):
            known = known.unionByName(self._rows([entry["data"]], _ROWS).withColumn("n", F.lit(i + 1)))
        last = known.groupBy("document_id").agg(F.max_by(F.struct("status", "checksum", "error_message", "deleted"), "n").alias("r"))
        return last.where("not r.deleted").select("document_id", "r.status", "r.checksum", "r.error_message")

    # --- changes

    def change(self, make: Callable[[DataFrame], DataFrame], stream: str = "", batch: int = -1) -> int:
        """The version at which make(state) is in the manifest: rows (document_id, status, checksum, error_message, deleted)
        of what changes. A batch of a stream that is there already changes nothing."""
        while True:
            now = self.version()
            base, log = self._base(now)
            seen = [base.get("streams", {}).get(stream, -1), *[x["batch"] for x in log if x["stream"] == stream]]
            if stream and max(seen) >= batch:
                return now
            name = uuid.uuid4().hex
            make(self._state(base, log)).select(*[c.split()[0] for c in _ROWS.split(", ")]).write.parquet(f"{self.path}/data/{name}")
            if self._take("log", now + 1, {"data": name, "stream": stream, "batch": batch}):
                if len(log) + 1 >= self.compact_after:
                    self.compact()
                return now + 1
            fs, lost = filesystem(self.spark, f"{self.path}/data/{name}")
            fs.delete(lost, True)

    def evaluate(self, files: DataFrame, stream: str = "", batch: int = -1) -> int:
        """files (document_id, checksum[, seen_at]) are new, unchanged or modified; what was missing or failed is judged by its
        checksum too, and its error goes. Of a document's rows the one with the latest seen_at, then with the largest
        checksum, counts. Only what differs from the state is written."""
        order = [c for c in ("seen_at", "checksum") if c in files.columns]

        def make(state: DataFrame) -> DataFrame:
            seen = files.groupBy("document_id").agg(F.max_by("checksum", F.struct(*order)).alias("checksum"))
            old = state.select("document_id", F.col("checksum").alias("old"), F.col("status").alias("was"))
            status = F.when(F.col("was").isNull(), "new").when(F.col("old") == F.col("checksum"), "unchanged").otherwise("modified")
            judged = seen.join(old, "document_id", "left").withColumn("status", status).where("was is null or was <> status or old is distinct from checksum")
            return judged.select("document_id", "status", "checksum", F.lit(None).cast("string").alias("error_message"), F.lit(False).alias("deleted"))

        return self.change(make, stream, batch)

    def mark_missing(self, scan: DataFrame) -> int:
        """After a full scan (document_id): documents that it does not have are missing."""
        gone = lambda state: state.where("status <> 'missing'").join(scan.select("document_id"), "document_id", "left_anti")
        return self.change(lambda state: _marked(gone(state), F.lit("missing"), F.col("error_message")))

    def mark_failed(self, failed: DataFrame) -> int:
        """failed (document_id, error_message): entries that are there take the message; others are passed over."""
        told = failed.groupBy("document_id").agg(F.max("error_message").alias("told"))
        return self.change(lambda state: _marked(state.join(told, "document_id"), F.lit("failed"), F.col("told")))

    def delete(self, ids: DataFrame) -> int:
        """Entries of ids (document_id) go; they are new when they come again."""
        return self.change(lambda state: _marked(state.join(ids.select("document_id"), "document_id", "left_semi"), F.col("status"), F.col("error_message"), True))

    # --- compaction

    def compact(self) -> None:
        """A snapshot of the state now. What only versions before the last snapshot but one need is deleted; one is left, so
        that readers who began before can end."""
        now = self.version()
        base, log = self._base(now)
        if not log:
            return
        name, streams = uuid.uuid4().hex, dict(base.get("streams", {}))
        for x in log:
            if x["stream"]:
                streams[x["stream"]] = max(streams.get(x["stream"], -1), x["batch"])
        self._state(base, log).write.parquet(f"{self.path}/data/{name}")
        if not self._take("snapshots", now, {"data": name, "streams": streams}):
            return
        last = base.get("version", 0)
        stale = {"log": [n for n in self._numbers("log") if n <= last], "snapshots": [n for n in self._numbers("snapshots") if n < last]}
        for kind, numbers in stale.items():
            for number, told in self._told(kind, numbers).items():
                for gone in (f"{kind}/{number:012d}.json", f"data/{told['data']}"):
                    fs, path = filesystem(self.spark, f"{self.path}/{gone}")
                    fs.delete(path, True)


def _marked(rows: DataFrame, status: Column, error: Column, deleted: bool = False) -> DataFrame:
    return rows.select("document_id", status.alias("status"), "checksum", error.alias("error_message"), F.lit(deleted).alias("deleted"))
