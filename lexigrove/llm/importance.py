"""Importance resampling towards a target distribution, drawn by an exact histogram of integer scores.

Hashed word features give each bucket a gain: how much likelier it is in the target than in the corpus. The gains are
one array of fixed length that every task holds; a document's weight is read from it feature by feature, without a
join. Its score adds Gumbel noise, which turns "the highest scores" into a draw without replacement. Scores are whole
numbers: a histogram of them, summed from the top, gives each score the rank its first document has and finds the score
at which the draw ends. Within a score, ranks go on by id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import Scratch, documents, map_rows, partitions, ranked, with_fields

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # on UTF-8 in lower case: every byte of a code point beyond ASCII is 0x80 or more
_KNOWN = 500_000  # words whose bucket a task remembers


class Buckets(dict):
    """The bucket of a feature: its crc32 modulo the number of buckets, remembered for the words met last."""

    def __init__(self, many: int):
        self.many = many

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        got = zlib.crc32(feature) % self.many
        if len(feature) <= 64:
            self[feature] = got
        return got

    def of(self, text: bytes | None, longest: int) -> np.ndarray:
        """Buckets of all runs of 1 to `longest` words of a text, repeats included."""
        words = _WORD.findall(text.lower()) if text else []
        runs = [words, *([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, longest + 1))]
        return np.fromiter((self[f] for run in runs for f in run), np.int64)


def bucket_counts(texts: DataFrame, text_col: str, many: int, longest: int) -> DataFrame:
    """(bucket, n) over all texts; a task adds up its own counts and passes on at most one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(many), np.zeros(many, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(known.of(text.as_py(), longest), minlength=many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, scratch: Scratch, text_col: str, target_col: str, many: int, longest: int) -> DataFrame:
    """(bucket, gain) for each bucket that is in the corpus, in thousandths of a nat, rounded down, with counts raised by one."""
    s = bucket_counts(docs, text_col, many, longest)
    t = bucket_counts(target, target_col, many, longest).select("bucket", F.col("n").alias("t"))
    both = scratch.save(s.join(t, "bucket", "full").select("bucket", F.coalesce("n", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts")
    all_s, all_t = (x or 0 for x in both.agg(F.sum("s"), F.sum("t")).first())
    wide = lambda c: c.cast("double")
    ratio = wide(F.col("t") + 1) * F.lit(float(all_s + many)) / (wide(F.col("s") + 1) * F.lit(float(all_t + many)))
    return both.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gained: DataFrame, id_col: str, text_col: str, many: int, longest: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_features, weight, then c0, c1 and so on): the mean gain of a document's features, rounded down; 0 without features."""
    table = np.zeros(many, np.int64)
    for bucket, gain in gained.collect():  # at most `many` rows
        table[bucket] = gain
    held = docs.sparkSession.sparkContext.broadcast(table)

    def score(rows: Iterator[dict]) -> Iterator[tuple]:
        known, gain = Buckets(many), held.value
        for row in rows:
            found = known.of(row["text"], longest)
            yield (row["id"], len(found), int(gain[found].sum()) // len(found) if len(found) else 0, *(row[f"c{i}"] for i in range(len(carry))))

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(src, score, with_fields(f"id {kind}, n_features long, weight long", docs, carry))


def draw(scored: DataFrame, scratch: Scratch, share: tuple[int, int]) -> DataFrame:
    """scored with `rank`: of the N rows where `fit`, the first floor(share * N) by falling score, then id, counted from 1; null for the rest.

    scored should be a saved table. The histogram has one row for each score; scores beyond the cutoff are never sorted.
    """
    levels = scored.where("fit").groupBy("score").agg(F.count("*").alias("n"))
    levels = scratch.save(levels, "histogram")
    many = (levels.agg(F.sum("n")).first()[0] or 0) * share[0] // share[1]
    above = ranked_sums(levels, scratch)
    cut = above.where((F.col("above") < many) & (F.col("above") + F.col("n") >= many)).select("score").first()
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    taken = scored.where(F.col("fit") & (F.col("score") >= cut["score"]))
    placed = ranked(taken, scratch, "surviving", ["score"], ["id"], partitions(scored.sparkSession, many, 1_000_000)).withColumnRenamed("rank", "place")
    offsets = above.where(F.col("score") >= cut["score"]).select("score", "above")
    placed = placed.join(offsets, "score").withColumn("rank", F.col("above") + F.col("place") + 1).select(*scored.columns, "rank")
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return drawn.unionByName(scored.where(~(F.col("fit") & (F.col("score") >= cut["score"]))).withColumn("rank", F.lit(None).cast("long")))


def ranked_sums(levels: DataFrame, scratch: Scratch) -> DataFrame:
    """levels (score, n) with `above`: the sum of n over all higher scores.

    Scores are dealt by range, sums run within a part and the parts' totals are added: no task holds all scores.
    """
    parts = partitions(levels.sparkSession, 0, 1)
    dealt = levels.repartitionByRange(parts, F.desc("score")).withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, "levels")
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("n").alias("whole"))  # one row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("before"))
    return dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "part").select("score", "n", (F.col("before") + F.col("inside")).alias("above"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", many: int = 10_000,
    longest: int = 1, least_words: int = 20, share: tuple[int, int] = (10, 100), seed: str = "2024", carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_features, weight, score, rank, and the columns in carry under their own names); rank is null for what is not drawn.

    Texts are read twice: for the counts and for the weights. What is shuffled are counts for each bucket and task, and
    the ids and scores of what is drawn. The gains are `many` numbers, whatever the corpus.

    Defined cases: null and empty texts and texts without a word have no features, weight 0 and are never drawn, but
    have a score; a text of any length is one row; a null id is hashed as an empty one and comes last among ties;
    repeated rows each have a rank of their own, and rows alike in score and id are interchangeable; an empty target
    gives gains from the corpus alone; an empty corpus gives an empty table; a share of less than one document draws
    none; columns that are not named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    gained = gains(docs, target, scratch, text_col, target_col, many, longest)
    weighed = weigh(docs, gained, id_col, text_col, many, longest, carry)
    words = F.col("n_features") if longest == 1 else word_count(F.col("n_features"), longest)
    scored = weighed.withColumns({"score": F.col("weight") + noise(F.col("id"), seed), "fit": words >= F.lit(least_words)})
    out = draw(scratch.save(scored, "scored"), scratch, share)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def word_count(features: Column, longest: int) -> Column:
    """The number of words that has so many runs of 1 to `longest` words."""
    below = F.lit(longest * (longest - 1) // 2)  # w words have longest * w - below runs, from `longest` words on
    few = F.floor((F.sqrt(8 * features + 1) - 1) / 2)  # fewer words: w * (w + 1) / 2 runs
    return F.when(features >= longest * longest - below, (features + below) / longest).otherwise(few).cast("long")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = {
    "op13_importance": r"""
WITH step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents),
aims AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
coded AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM words UNION SELECT w FROM aims)),
crc AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::UBIGINT)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM coded, step),
s AS (SELECT bucket, count(*) AS s FROM words JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN crc USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM words)::DOUBLE AS all_s, (SELECT count(*) FROM aims)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN crc USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM ranks) * 10 // 100 THEN r END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)"""
}
