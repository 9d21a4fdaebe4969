"""The manifest log: statuses over changes, writers at once, batches that run again, compaction."""

import os

import pytest

from lexigrove.streaming.manifest_log import ManifestLog

ONE = "document_id string, checksum string"


@pytest.fixture
def log(spark, tmp_path):
    return ManifestLog(spark, f"file://{tmp_path}/m", compact_after=4)


def files(spark, **checksums):
    return spark.createDataFrame(list(checksums.items()), ONE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "document_id string")


def state(log, version=None):
    return {r["document_id"]: (r["status"], r["checksum"], r["error_message"]) for r in log.read(version).collect()}


def test_one_document_after_another_status(spark, log):
    """New, unchanged, modified, unchanged, missing, seen again, failed, seen again, deleted, new."""
    steps = [
        (lambda: log.evaluate(files(spark, a="1")), ("new", "1", None)), (lambda: log.evaluate(files(spark, a="1")), ("unchanged", "1", None)),
        (lambda: log.evaluate(files(spark, a="2")), ("modified", "2", None)), (lambda: log.evaluate(files(spark, a="2")), ("unchanged", "2", None)),
        (lambda: log.mark_missing(ids(spark)), ("missing", "2", None)), (lambda: log.evaluate(files(spark, a="2")), ("unchanged", "2", None)),
        (lambda: log.mark_failed(spark.createDataFrame([("a", "broken"), ("zz", "unknown")], "document_id string, error_message string")), ("failed", "2", "broken")),
        (lambda: log.evaluate(files(spark, a="3")), ("modified", "3", None)), (lambda: log.delete(ids(spark, "a", "zz")), None), (lambda: log.evaluate(files(spark, a="3")), ("new", "3", None)),
    ]
    assert state(log) == {}
    for n, (step, want) in enumerate(steps):
        assert step() == n + 1
        assert state(log).get("a") == want


def test_a_batch_again_changes_nothing(spark, log):
    log.evaluate(files(spark, a="1"), "s", 0)
    log.mark_missing(ids(spark))
    assert log.evaluate(files(spark, a="1"), "s", 0) == 2 and state(log)["a"][0] == "missing"
    for _ in range(6):  # compacted meanwhile
        log.delete(ids(spark, "none"))
    at = log.version()
    assert log.evaluate(files(spark, a="1"), "s", 0) == at and log.evaluate(files(spark, a="1"), "other", 0) == at + 1 and log.evaluate(files(spark, a="9"), "s", 1) == at + 2


def test_the_second_writer_works_on_what_the_first_left(spark, log):
    log.evaluate(files(spark, a="1"))
    other, calls = ManifestLog(spark, log.path), []

    def make(now):
        if not calls:
            other.evaluate(files(spark, b="1"))  # takes the version that was meant for this change
        calls.append({r["document_id"] for r in now.collect()})
        return now.selectExpr("document_id", "'missing' as status", "checksum", "error_message", "false as deleted")

    assert log.change(make) == 3
    assert calls == [{"a"}, {"a", "b"}] and {k: v[0] for k, v in state(log).items()} == {"a": "missing", "b": "missing"}


def test_reads_do_not_grow_with_versions(spark, log, tmp_path):
    for n in range(17):
        log.evaluate(files(spark, a=str(n), **{f"d{n}": "1"}))
    assert len(os.listdir(tmp_path / "m/log")) <= 2 * 8 + 2 and len(os.listdir(tmp_path / "m/data")) <= 12  # check sums of files count too
    base, entries = log._base(log.version())
    assert base["version"] >= 13 and len(entries) < 4
    assert state(log)["a"] == ("modified", "16", None) and len(state(log)) == 18
    assert state(log, 15)["a"] == ("modified", "14", None)
    with pytest.raises(ValueError, match="compacted"):
        log.read(2)


def test_only_changes_are_written(spark, log, tmp_path):
    log.evaluate(files(spark, a="1", b="1"))
    log.evaluate(files(spark, a="1", b="1"))
    log.evaluate(files(spark, a="1", b="1"))
    names = [x["data"] for x in log._base(3)[1]]
    assert [spark.read.parquet(f"file://{tmp_path}/m/data/{n}").count() for n in names] == [2, 2, 0]
