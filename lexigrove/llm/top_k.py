"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, so scores are exact. Distinct vectors are grouped by length into buckets of bounded size, and
a bucket's vectors are held by one task, past which queries are streamed: no vector is copied for a block of queries,
and a query travels once to each bucket that it has to visit. The bucket of the longest vectors comes first and gives
each query a score that its k-th best reaches. A block of queries then visits a bucket only where its lengths allow
that score. Within a bucket, the score over both lengths is the cosine a candidate must reach: where it is high, a
candidate's strongest coordinates of the query must lie in the interval that this angle allows; where it is low, its
length alone is tested. Products are computed for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import Scratch

_BUCKET_BYTES, _BUCKET_ROWS = 32 << 20, 2048  # a bucket's vectors: most bytes, and rows below which none is split
_BLOCK = 256  # queries of which visits are decided together
_STREAM = 50_000  # queries that one task streams past a bucket
_FOCUS = 4  # coordinates that coordinate pruning looks at
_STEEP = 0.25  # the local cosine threshold from which coordinates are worth looking at
_NONE = -(1 << 63)  # no score is known that must be reached
_SLOT = ("dim", "bucket", "sub", "salt")


def usable(v: Column) -> Column:
    """A vector with components, none of them null or non-finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


class Bucket:
    """Vectors of one bucket, in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order]
        self.most = float(np.abs(self.v.astype(np.float64)).max(initial=0))
        self.floats = self.v.astype(np.float64)
        self.length = np.sqrt((self.floats**2).sum(1))
        self.longest = float(self.length.max(initial=0))

    def products(self, q: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Integer inner products, pinned to 64 bits; floating point is used where it is exact."""
        if float(np.abs(q.astype(np.float64)).max(initial=0)) * self.most * max(q.shape[1], 1) < 2**53:
            return (q.astype(np.float64) @ self.floats[at].T).astype(np.int64)
        exact = q.astype(object) @ self.v[at].astype(object).T
        return np.maximum(np.minimum(exact, (1 << 63) - 1), -(1 << 63)).astype(np.int64)

    def search(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query's place, id, score) of the k best for each query that reach its least score."""
        size = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        known = least != _NONE
        floor = least.astype(np.float64)
        floor -= 1e-9 * (np.abs(floor) + 1)
        need = np.where(known & (floor > 0), floor / np.maximum(size * self.longest, 1e-300), 0.0)
        for lo in range(0, len(q), 64):
            block = np.arange(lo, min(lo + 64, len(q)))
            block = block[need[block] <= 1]
            keep = self.ids[None, :] != own[block][:, None]
            for row, i in enumerate(block):
                if need[i] >= _STEEP:  # by coordinates
                    x, beta = q[i], np.arccos(min(1.0, need[i]))
                    for f in np.argsort(-np.abs(x.astype(np.float64)))[:_FOCUS]:
                        alpha = np.arccos(np.clip(float(x[f]) / size[i], -1, 1))
                        low, high = np.cos(min(np.pi, alpha + beta)), np.cos(max(0.0, alpha - beta))
                        c = self.floats[:, f]
                        keep[row] &= (c >= (low - 1e-9) * self.length) & (c <= (high + 1e-9) * self.length)
                elif need[i] > 0:  # by length
                    keep[row] &= self.length * size[i] >= floor[i]
            if keep.mean() > 0.1 if keep.size else False:
                scores = self.products(q[block])
                found = [(np.flatnonzero(m), s[m]) for m, s in zip(keep, scores)]
            else:
                found = [(at, self.products(q[i : i + 1], at)[0]) for i, at in zip(block, map(np.flatnonzero, keep))]
            for i, (at, score) in zip(block, found):
                if len(score) > k:
                    best = score >= np.partition(score, len(score) - k)[len(score) - k]
                    at, score = at[best], score[best]
                order = np.lexsort((at, -score.astype(object))) if len(score) and score.min() == _NONE else np.lexsort((at, -score))
                for j in order[:k]:
                    if not known[i] or score[j] >= least[i]:
                        yield int(i), int(self.ids[at[j]]), int(score[j])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _visit(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, its vectors (role 0) before the queries (role 1) that visit it."""
    at, held, bucket = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*_SLOT, "role")], 1)
        edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
        for lo, hi in zip(edges, [*edges[1:], len(keys)]):
            part, slot, dim = batch.slice(lo, hi - lo), tuple(keys[lo, :4]), int(keys[lo, 0])
            if slot != at:
                at, held, bucket = slot, [], None
            ids, vectors = part.column("id").to_numpy(zero_copy_only=False), _matrix(part.column("vec"), dim)
            if keys[lo, 4] == 0:
                held.append((ids.copy(), vectors.copy()))
                continue
            if bucket is None:
                bucket = Bucket(*(np.concatenate(x) for x in zip(*held))) if held else Bucket(np.zeros(0, np.int64), np.zeros((0, dim), np.int64))
                held = []
            query, least = (part.column(c).to_numpy(zero_copy_only=False) for c in ("query", "least"))
            rows = [(query[i], ids[i], other, score) for i, other, score in bucket.search(vectors, ids, least, k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query", "query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best among all others.

    Of rows with one vector, only the k + 1 smallest ids can be among anyone's best; the others are left out of
    the search, which changes no result.

    Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
    without an id; only vectors of the query's dimension are candidates; ties go to the smaller id; a row that
    repeats id and vector counts once, and no row of the query's id is its candidate; fewer than k candidates
    give fewer rows; scaled components beyond 64 bits are pinned to the ends of that range, and so are exact
    scores, before they are ranked; an empty table gives an empty one; columns that are not named are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    ints = src.select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("vec"))
    ints = ints.select("id", "vec", F.size("vec").alias("dim"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("norm2")).distinct()
    ints = scratch.save(ints, "ints")

    same = Window.partitionBy("vec").orderBy("id")
    kept = scratch.save(ints.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"), "distinct")
    have, widest = kept.agg(F.count("*"), F.max("dim")).first()
    most = max(1, _BUCKET_BYTES // (8 * (widest or 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, min(most, max(_BUCKET_ROWS, -(-have // parts))))
    many = max(1, min(4096, -(-have // rows)))
    cuts = []
    if many > 1:  # at most 4095 numbers
        cuts = sorted(set(kept.agg(F.percentile_approx("norm2", [i / many for i in range(1, many)], 20_000)).first()[0]))
    bucket = F.lit(0)
    if cuts:
        bucket = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("norm2")))
    kept = kept.withColumn("bucket", bucket.cast("int"))
    sizes = kept.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / rows).cast("int").alias("subs"))
    kept = kept.join(sizes, ["dim", "bucket"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).drop("subs")
    kept = scratch.save(kept, "kept")
    meta = kept.groupBy("dim", "bucket", "sub").agg(F.max("norm2").alias("longest"))

    asked = ints.where(F.col("id") % every == 0)
    asking = asked.count()
    blocks, salts = max(1, -(-asking // _BLOCK)), max(1, -(-asking // _STREAM))
    hashed = F.xxhash64("id")
    asked = asked.withColumns({"query": F.xxhash64("id", "vec"), "block": F.pmod(hashed, F.lit(blocks)).cast("int"), "salt": F.pmod(F.shiftright(hashed, 32), F.lit(salts)).cast("int")})
    asked = scratch.save(asked, "asked")

    def search(have: DataFrame, ask: DataFrame) -> DataFrame:
        shape = [*_SLOT, "role", "id", "vec", "query", "least"]
        zero = {"role": F.lit(0), "query": F.lit(0).cast("long"), "least": F.lit(0).cast("long")}
        left = have.withColumns(zero | {"salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))}).select(*shape)
        routed = left.unionByName(ask.withColumn("role", F.lit(1)).select(*shape))
        dealt = routed.repartition(*_SLOT).sortWithinPartitions(*_SLOT, "role")
        return dealt.mapInArrow(lambda b: _visit(b, k), "query long, query_id long, vec_id long, score long")

    ends = meta.groupBy("dim").agg(F.min(F.struct("bucket", "sub")).alias("first")).select("dim", "first.*")
    first = search(kept.join(ends, ["dim", "bucket", "sub"], "left_semi"), asked.join(ends, "dim").withColumn("least", F.lit(_NONE).cast("long")))
    first = scratch.save(first, "first")
    least = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query", "least")
    asked = asked.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(_NONE).cast("long")))
    asked = scratch.save(asked, "bounded")

    # which buckets a block of queries has to visit: one row for each block, and one for each bucket
    reach = F.when(F.col("least") == _NONE, F.lit(float("-inf"))).otherwise(F.col("least") / F.sqrt(F.greatest("norm2", F.lit(1e-300))))
    wish = asked.groupBy("dim", "block").agg(F.min(reach).alias("need"), F.count_if(F.col("norm2") == 0).alias("nil"))
    rest = meta.join(ends, ["dim", "bucket", "sub"], "left_anti")
    visits = wish.join(rest, "dim").where((F.sqrt("longest") * (1 + 1e-9) + 1e-9 >= F.col("need")) | (F.col("nil") > 0)).select("dim", "block", "bucket", "sub")
    visits = scratch.save(visits, "visits")
    found = first.unionByName(search(kept.join(visits.select("dim", "bucket", "sub").distinct(), ["dim", "bucket", "sub"], "left_semi"), asked.join(visits, ["dim", "block"])))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op6_top_k": """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""
}
