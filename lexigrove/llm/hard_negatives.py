"""Hard negatives by a full sort of each anchor's scores.

Vectors become integers, so scores are exact. Rows are dealt by id into slices of bounded size, each held by one task
in order of id, past which the anchors are streamed. In a slice, all of an anchor's scores are computed and sorted by
score and id. A first pass reads the anchor's best rows of its own label, its positives. In a second pass each
positive's upper limit is found by binary search among the sorted scores of other labels, and the k entries from
there on are read as long as they reach the lower limit. The first k over all slices are among the first k of each,
so merging them is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import Scratch
from lexigrove.llm.top_k import usable

_SLICE_BYTES, _SLICE_ROWS = 32 << 20, 2048  # a slice's vectors: most bytes, and rows below which none is split
_STREAM = 50_000  # anchors that one task streams past a slice
_SLOT = ("dim", "slice", "salt")
_PINNED = (-(1 << 63), (1 << 63) - 1)


class Slice:
    """Vectors of one slice in order of id, with their labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.v = ids[order], labels[order], vectors[order]
        self.floats = self.v.astype(np.float64)
        self.most = float(np.abs(self.floats).max(initial=0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Integer inner products with one anchor, pinned to 64 bits; floating point is used where it is exact."""
        if float(np.abs(x.astype(np.float64)).max(initial=0)) * self.most * max(len(x), 1) < 2**53:
            return (self.floats @ x.astype(np.float64)).astype(np.int64)
        exact = self.v.astype(object) @ x.astype(object)
        return np.maximum(np.minimum(exact, _PINNED[1]), _PINNED[0]).astype(np.int64)

    def sorted(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows `among`, the highest score first, ties by id. ~s falls as s rises and never overflows."""
        at = np.flatnonzero(among)
        score = self.scores(x)[at]
        order = np.lexsort((self.ids[at], ~score))
        return at[order], score[order]

    def positives(self, x: np.ndarray, own: int, label: int, n: int) -> Iterator[tuple[int, int]]:
        at, score = self.sorted(x, (self.labels == label) & (self.ids != own))
        yield from zip(self.ids[at[:n]].tolist(), score[:n].tolist())

    def negatives(self, x: np.ndarray, own: int, label: int, positives: list[tuple[int, int]], k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """(positive's id and score, id and score) of the first k between the limits, for each positive."""
        at, score = self.sorted(x, (self.labels != label) & (self.ids != own))
        falling = ~score  # ascends
        for positive, of in positives:
            least, most = max(-(-low * of // 100), _PINNED[0]), high * of // 100  # whole numbers: the limits are exact
            if least > _PINNED[1] or most < _PINNED[0]:
                continue
            first = int(np.searchsorted(falling, ~min(most, _PINNED[1]), "left"))
            for i, s in zip(at[first : first + k], score[first : first + k].tolist()):
                if s < least:
                    break
                yield positive, of, int(self.ids[i]), s


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _past(batches: Iterator[pa.RecordBatch], answer, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot, a slice's vectors (role 0) before the anchors (role 1); answer(slice, vector, id, label, row) yields tuples."""
    at, held, part = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*_SLOT, "role")], 1)
        edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
        for lo, hi in zip(edges, [*edges[1:], len(keys)]):
            rows, slot, dim = batch.slice(lo, hi - lo), tuple(keys[lo, :3]), int(keys[lo, 0])
            if slot != at:
                at, held, part = slot, [], None
            ids, labels = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            vectors = _matrix(rows.column("vec"), dim)
            if keys[lo, 3] == 0:
                held.append((ids.copy(), labels.copy(), vectors.copy()))
                continue
            if part is None:
                part = Slice(*(np.concatenate(x) for x in zip(*held))) if held else Slice(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim), np.int64))
                held = []
            found = [t for i in range(len(ids)) for t in answer(part, vectors[i], int(ids[i]), int(labels[i]), rows.slice(i, 1))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], list(names))


def mine_hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`, positives the best rows of an anchor's label. A positive's
    negatives are the first k rows of other labels with low * positive_score <= 100 * score <= high * positive_score.

    Rows are dealt by id, so that neither a label nor a group of copies is one task's work. Anchors travel once to each
    slice; a pass returns at most `positives` rows, then at most positives * k rows, for each anchor and slice.

    Defined cases: rows with a null id or label, and vectors that are null, empty or hold null or non-finite
    components, take no part; only vectors of the anchor's dimension count; a row that repeats id, label and vector
    counts once, and no row of the anchor's id is its positive or negative; rows of one id with different labels or
    vectors are rows of their own, as anchors too, each with its own positives; ties go to the smaller id; a positive
    whose score is negative has no negatives, as its limits cross; fewer rows than asked for give fewer rows; scaled
    components and scores beyond 64 bits are pinned to the ends of that range; an empty table gives an empty one;
    columns that are not named are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    ints = src.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("vec"))
    ints = scratch.save(ints.withColumn("dim", F.size("vec")).distinct(), "ints")
    have, widest, asking = ints.agg(F.count("*"), F.max("dim"), F.count_if(F.col("id") % every == 0)).first()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, min(_SLICE_BYTES // (8 * (widest or 1)), max(_SLICE_ROWS, -(-have // parts))))
    slices, salts = max(1, -(-have // rows)), max(1, -(-asking // _STREAM))
    by_id = F.xxhash64("id")
    held = ints.withColumns({"slice": F.pmod(by_id, F.lit(slices)).cast("int"), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))), "role": F.lit(0), "anchor": F.lit(0).cast("long")})
    anchors = ints.where(F.col("id") % every == 0).withColumn("anchor", F.xxhash64("id", "label", "vec"))
    anchors = scratch.save(anchors, "anchors")

    def search(ask: DataFrame, answer, names: str) -> DataFrame:
        placed = ask.withColumns({"slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), "salt": F.pmod(F.shiftright(by_id, 32), F.lit(salts)).cast("int"), "role": F.lit(1)})
        dealt = held.unionByName(placed, allowMissingColumns=True).repartition(*_SLOT).sortWithinPartitions(*_SLOT, "role")
        return dealt.mapInArrow(lambda b: _past(b, answer, tuple(names.split())), ", ".join(f"{n} long" for n in names.split()))

    def own(part: Slice, x: np.ndarray, doc: int, label: int, row: pa.RecordBatch) -> Iterator[tuple]:
        anchor = row.column("anchor")[0].as_py()
        return ((anchor, *t) for t in part.positives(x, doc, label, positives))

    near = search(anchors, own, "anchor positive_id positive_score")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives"))  # at most `positives` of them
    asked = scratch.save(anchors.join(lists, "anchor"), "asked")

    def other(part: Slice, x: np.ndarray, doc: int, label: int, row: pa.RecordBatch) -> Iterator[tuple]:
        mine = [(p["positive_id"], p["positive_score"]) for p in row.column("positives")[0].as_py()]
        anchor = row.column("anchor")[0].as_py()
        return ((anchor, doc, *t) for t in part.negatives(x, doc, label, mine, k, low, high))

    found = search(asked, other, "anchor anchor_id positive_id positive_score negative_id negative_score")
    first = Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    wide = F.col("label").cast("decimal(20,0)")  # label + 1 fits whatever the label
    moved = F.when(F.col("vec_id") % 7 == 0, ((wide + 1) % 10).cast("long")).otherwise(F.col("label").cast("long"))
    return mine_hard_negatives(src.withColumn("label", moved))


ORACLE = {
    "op11_hard_negatives": """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE))::DOUBLE[] AS v,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM ints a JOIN ints b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
}
