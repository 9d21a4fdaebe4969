"""What several operators of this subpackage share: scratch tables, ranks, Arrow batches, components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexigrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's default of rows that travel to Python at once, and what is set in its place: texts may be long.
_BATCH, _SMALL_BATCH = "10000", "2000"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor never makes an earlier step run again.

    An operator's result reads its tables, so they stay until `release`, which knows those of its own thread: two
    pipelines of one session leave each other's tables alone. Unless the session says otherwise, rows reach Python in
    small batches.
    """

    _made: dict[int, list[Scratch]] = {}

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lexigrove/{label}-{uuid.uuid4().hex}"
        self.made().append(self)
        if spark.conf.get(_BATCH_ROWS, _BATCH) == _BATCH:
            spark.conf.set(_BATCH_ROWS, _SMALL_BATCH)

    @classmethod
    def made(cls) -> list[Scratch]:
        """Those that this thread has made and not released."""
        return cls._made.setdefault(threading.get_ident(), [])

    @classmethod
    def release(cls, since: int = 0) -> None:
        """Delete the tables of all Scratches that this thread made after the first `since`, once their results are written
        elsewhere."""
        for one in cls.made()[since:]:
            one.drop("")
        del cls.made()[since:]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: str | T.StructType, flush: int = 512) -> DataFrame:
    """fn over each partition's rows, which reach Python as Arrow batches; it yields tuples of the schema.

    Rows are unpacked a few at a time, so that a batch of long texts is never held twice.
    """
    to = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from batch.slice(at, 64).to_pylist()

        out: list[tuple] = []
        size = 0
        for row in fn(rows()):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes))) + 16
            if len(out) >= 20 * flush or size >= 4 << 20:
                yield _pack(out, to)
                out, size = [], 0
        if out:
            yield _pack(out, to)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def with_fields(schema: str, df: DataFrame, columns: tuple[str, ...]) -> T.StructType:
    """schema, then c0, c1 and so on of the types of df's columns."""
    out = T.StructType.fromDDL(schema)
    for i, c in enumerate(columns):
        out = out.add(f"c{i}", df.schema[c].dataType)
    return out


_HOT = 10_000
_HUB = 100_000  # edges of one node that an ordinary join takes in any case


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key, and in `weight` how many rows of left have it.

    A key is hot if it has more than one in 10 000 of all rows, so there are fewer than 10 000 hot keys: these are
    broadcast, and their rows of left stay where they are. All other rows are shuffled by key. left is read twice
    and should be a saved table.
    """
    least = (right.agg(F.sum(weight)).first()[0] or 0) // _HOT
    hot = F.broadcast(right.where(F.col(weight) > least))
    apart = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on).unionByName(apart.join(right.where(F.col(weight) <= least), on, how), allowMissingColumns=True)


def joins_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, scratch: Scratch, name: str) -> Callable[[DataFrame], DataFrame]:
    """`join_hot` of left, for tables that are joined with it again and again: what it returns takes such a table.

    Hot keys are found and left is parted once, by right; a table given later has right's keys and weights, and may have
    several rows for a key. Where all keys are hot, left stays in one and a join is one broadcast.
    """
    total, fewest = right.agg(F.sum(weight), F.min(weight)).first()
    least = (total or 0) // _HOT
    if fewest is None or fewest > least:
        return lambda table: left.join(F.broadcast(table), on)
    keys = F.broadcast(right.where(F.col(weight) > least).select(*on))
    hot, others = scratch.save(left.join(keys, on), f"{name}-hot"), scratch.save(left.join(keys, on, "left_anti"), f"{name}-others")
    return lambda table: hot.join(F.broadcast(table.where(F.col(weight) > least)), on).unionByName(others.join(table.where(F.col(weight) <= least), on))


def _pack(rows: list[tuple], to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), to)], schema=to)


def ranked(df: DataFrame, scratch: Scratch, name: str, group: list[str], order: list[str], parts: int) -> DataFrame:
    """df with `rank`: the row's place, from 0, within its group in the given order.

    Rows are dealt by range over (group, order), so a group of any size spreads over tasks; the places before
    a partition come from one count for each group and partition. Rows alike in all these columns are
    interchangeable.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    dealt = scratch.save(dealt, name)
    runs = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), "_first", "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)] + [F.col("_part") == F.col("_p")]
    out = dealt.join(runs, on, "left")
    return out.select(*df.columns, (F.col("_before") + F.col("_seq") - F.col("_first")).alias("rank"))


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions so that each holds about that many rows; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(id, component) for the ends of edges (a, b): component is the smallest id reachable.

    Large-star and small-star steps alternate until every node hangs on its root; each step is written to the shared folder.
    Nothing is gathered: a node's edges are a join with their minimum, and where some node has more than one in 10 000
    of all, that join is `join_hot`.
    """
    spark = edges.sparkSession
    written = 0

    def star(e: DataFrame, small: bool, hub: bool) -> DataFrame:
        nonlocal written
        if small:  # from each node to its smaller neighbours
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        if hub:
            both, written = scratch.save(both, f"{name}-both-{written}"), written + 1
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree")).select("u", F.least("u", "low").alias("m"), "degree")
        linked = join_hot(both, least, ["u"], "degree") if hub else both.join(least, "u")
        if small:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        else:
            out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame) -> tuple[bool, bool]:
        """Whether some node has two parents, or is both child and parent; and whether some node is a hub."""
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(e.select(F.col("b"), F.lit(0), F.lit(1)))
        seen = ends.groupBy("v").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"), F.count("*").alias("n"))
        open_, most, all_ = seen.agg(F.count_if(F.expr("child > 1 or (child = 1 and parent = 1)")), F.max("n"), F.sum("n")).first()
        return open_ > 0, (most or 0) > max(_HUB, (all_ or 0) // _HOT)

    now = scratch.save(edges.select("a", "b").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    last, k = f"{name}-edges", 0
    while True:
        unsettled, hub = state(now)
        if not unsettled:
            break
        if k == rounds:
            raise RuntimeError("components did not settle")
        now = scratch.save(star(star(now, False, hub), True, hub), f"{name}-{k}")
        scratch.drop(*[f"{name}-both-{i}" for i in range(max(0, written - 2), written)])
        scratch.drop(last)
        last, k = f"{name}-{k}", k + 1
    parents = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return parents.union(roots)
