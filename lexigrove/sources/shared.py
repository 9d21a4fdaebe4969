"""Where tables are kept that driver and executors both read, and when the files under a table have changed."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexigrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under path: one listing, whose rows are added up by Spark.

    A file that is replaced by one of the same size within the same millisecond goes unseen.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)  # contents are not read
    told = files.select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    n, mixed, added = told.agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{n:x}-{(mixed or 0) & (1 << 64) - 1:016x}-{int(added or 0) & (1 << 64) - 1:016x}"


def filesystem(spark: SparkSession, name: str):
    """The Hadoop file system that has a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = filesystem(spark, name)
    return fs.exists(path)


def publish(spark: SparkSession, name: str, write: Callable[[str], None]) -> None:
    """write(folder) fills a folder beside `name`, which takes that name once it is whole; if the name is taken by then,
    what is there stays."""
    made = f"{name}.{uuid.uuid4().hex}"
    write(made)
    fs, source = filesystem(spark, made)
    target = filesystem(spark, name)[1]
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)


_PARTITION = 16 << 20  # bytes of files that a task reads


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, 0 where it reads none."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = (jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)) for name in df.inputFiles())
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster runs tasks at once, and with at most about `_PARTITION` bytes of its
    files in each: a table of a few files is dealt out, and a task's work does not grow with the table."""
    want = max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // _PARTITION))
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


_BATCH = 500  # rows that Python gets at once


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of `_BATCH`, where the session has Spark's default of 10 000: rows here are whole texts,
    postings and vectors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, _BATCH)


_made: dict[int, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for tables that results are read from until `release`."""
    path = f"{shared_dir(spark)}/lexigrove/{label}-{uuid.uuid4().hex}"
    _made.setdefault(threading.get_ident(), []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what this thread's operators have put under `scratch`, once their results are written elsewhere."""
    paths = _made.pop(threading.get_ident(), [])
    for name in paths:
        fs, path = filesystem(spark, name)
        fs.delete(path, True)
    return len(paths)


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written to a folder of its own in the shared folder and read from there: for what is read more than once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
