"""Sources by name: what a configuration lists is read by connectors and brought together; one that fails is reported."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.sources.tables import scan_folder

Connector = Callable[[SparkSession, dict], DataFrame]
_CONNECTORS: dict[str, Connector] = {}
REPORT = "source string, connector string, status string, error string"
FILES = ("source", "path", "extension", "size", "checksum", "content")


def connector(name: str) -> Callable[[Connector], Connector]:
    """Makes a function of (spark, settings) known as a connector; a name that is taken fails."""
    key = name.strip().lower()

    def keep(fn: Connector) -> Connector:
        if not key or key in _CONNECTORS:
            raise ValueError(f"connector {name!r} is blank or there already")
        _CONNECTORS[key] = fn
        return fn

    return keep


@connector("local")
def local_folder(spark: SparkSession, settings: dict) -> DataFrame:
    """The files of a folder that all executors see: path, extensions, excluded, recursive."""
    return scan_folder(spark, settings["path"], tuple(settings["extensions"]), tuple(settings.get("excluded", ())), settings.get("recursive", True))


@connector("pages")
def page_table(spark: SparkSession, settings: dict) -> DataFrame:
    """Pages fetched before, a table of url and html: their bytes as those of files."""
    pages = spark.read.parquet(settings["path"])
    body = F.to_binary(F.coalesce("html", F.lit("")), F.lit("utf-8"))
    return pages.select(F.col("url").alias("path"), F.lit(".html").alias("extension"), F.length(body).cast("long").alias("size"), F.sha2(body, 256).alias("checksum"), body.alias("content"))


def settings_of(spark: SparkSession, path: str) -> list[dict]:
    """The sources of a JSON file: a list, or an object that holds it as `sources`. Each has a name and a connector."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    told = json.loads(text)
    told = told["sources"] if isinstance(told, dict) else told
    names = [s.get("name", "").strip() for s in told]
    if not all(names) or len(set(names)) < len(names) or not all(s.get("connector") for s in told):
        raise ValueError("each source needs a name of its own and a connector")
    return told


def ingest(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(files, report): the files of all sources that are enabled, with the source's name, and a row for each source.

    A source whose settings or folder are wrong fails here and is reported as failed, the others go on; one that is not
    enabled is reported as skipped. What a file holds is read when the files are used.
    """
    found, report = [], []
    for one in sources:
        told = (one["name"], one["connector"])
        if not one.get("enabled", True):
            report.append((*told, "skipped", None))
            continue
        try:
            files = _CONNECTORS[one["connector"].strip().lower()](spark, one)
            found.append(files.withColumn("source", F.lit(one["name"])).select(*FILES))
            report.append((*told, "read", None))
        except (KeyError, ValueError, PySparkException) as e:
            report.append((*told, "failed", f"{type(e).__name__}: {e}"[:500]))
    empty = spark.createDataFrame([], "source string, path string, extension string, size long, checksum string, content binary")
    return reduce(DataFrame.unionByName, found, empty), spark.createDataFrame(report, REPORT)


def report_counts(files: DataFrame, report: DataFrame) -> DataFrame:
    """The report with each source's files and bytes."""
    counted = files.groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return report.join(counted, "source", "left").fillna(0, ["files", "bytes"])
