"""Line dedup: a sharded minimal perfect hash over line hashes indexes fingerprint, count and last-document arrays.

1. Each document's line keys become 128-bit hashes; a partial aggregation in the task and one groupBy give, for
   each hash, the number of documents and the largest doc_id.
2. Hashes of two documents or more are dealt to shards. Each shard builds a minimal perfect hash (levels of bit
   arrays with ranks) and three arrays at its slots: fingerprint, count, last document.
3. Documents send (shard, hash) probes; a task reads a shard's arrays, then streams the probes past them. Lines
   are never joined with lines.
   Hashes with more than one in 10 000 of all probes, fewer than 10 000 hashes, have a shard of their own, which
   goes to every task (some 250 kB): their probes are answered where the document is read, so a line that a third of
   all documents hold is never one task's work.
4. What must go returns to the documents as one set of hashes for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import Scratch, map_rows, with_fields

_AFTER_FIRST = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point
_HOT = 10_000  # a hash is hot with more than one in so many probes
_KEYS_PER_SHARD, _PROBES_PER_SHARD = 65_536, 262_144
_TOGETHER = 4096  # lines that are probed at once in the index of hot ones


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """Two signed 64-bit halves of the key's hash, or None where the key is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key.translate(None, _AFTER_FIRST)) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash: at each level, keys alone in their cell set its bit and the others go on; a slot is the rank of its bit."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        bits = np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        """keys: distinct uint64."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
            size = max(64, -(-int(len(left) * load) // 64) * 64)
            cell = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[cell]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some, and any slot for other, keys that are not in the set."""
        out = np.full(len(keys), -1, np.int64)
        todo, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            cell = (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[cell >> 6], (cell & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            count = np.unpackbits(below.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1, dtype=np.int64)
            out[todo[hit]] = self.before[cell[hit] >> 6] + count
            todo, start = todo[~hit], start + size
        return out


def _count_lines(rows: Iterator[dict], min_chars: int) -> Iterator[tuple]:
    """(h1, h2, n, last) of the rows so far; the table is bounded, a hash may come more than once."""
    held: dict[tuple[int, int], list] = {}
    for row in rows:
        doc = row["id"]
        for h in {line_hash(x, min_chars) for x in (row["text"] or b"").split(b"\n")} - {None}:
            if (at := held.get(h)) is None:
                held[h] = [1, doc]
            else:
                at[0] += 1
                if doc is not None and (at[1] is None or doc > at[1]):
                    at[1] = doc
        if len(held) >= 100_000:
            yield from ((*h, *v) for h, v in held.items())
            held = {}
    yield from ((*h, *v) for h, v in held.items())


class Arrays:
    """A shard: a minimal perfect hash and, at its slots, fingerprints, counts, last documents and whether there is one."""

    KINDS = (np.int64, np.uint64, np.uint64, np.uint32, np.int64, np.uint8)

    def __init__(self, parts: list[np.ndarray]):
        sizes, words, self.prints, self.counts, self.last, self.known = parts
        self.hashed = PerfectHash(sizes, words)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, last: list) -> Arrays:
        """Distinct hashes; last has None where no document has an id."""
        key = _mix(h1, 77) ^ h2
        hashed = PerfectHash.build(key)
        at = hashed.slots(key)
        prints, counts, lasts, known = (np.zeros(len(key), k) for k in cls.KINDS[2:])
        prints[at], counts[at] = h1, np.minimum(n, 0xFFFFFFFF)
        known[at], lasts[at] = [x is not None for x in last], [x or 0 for x in last]
        return cls([hashed.sizes, hashed.words, prints, counts, lasts, known])

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.hashed.sizes, self.hashed.words, self.prints, self.counts, self.last, self.known)]

    @classmethod
    def read(cls, parts: list[bytes]) -> Arrays:
        return cls([np.frombuffer(x, k) for x, k in zip(parts, cls.KINDS)])

    def probe(self, h1: np.ndarray, h2: np.ndarray, own: np.ndarray, has: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes the shard has, and which of their lines go, for lines of the documents `own` (with an id where `has`)."""
        if not len(self.prints):
            return np.zeros(len(h1), bool), np.zeros(len(h1), bool)
        slot = self.hashed.slots(_mix(h1, 77) ^ h2)
        here = (slot >= 0) & (self.prints[slot] == h1)
        return here, here & (self.counts[slot] >= min_docs) & (self.known[slot] == 1) & (~has | (self.last[slot] != own))


def _build_shard(pdf):
    import pandas as pd

    last = [None if pd.isna(x) else int(x) for x in pdf["last"].astype(object)]
    made = Arrays.build(pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64), last)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]]} | {f"p{i}": [x] for i, x in enumerate(made.parts())})


def _probe(batches, min_docs: int):
    """Arrow batches in, sorted so that a shard's arrays come before its probes; (id, hash) of lines to drop out.

    Shards below 0 hold hot hashes that have been answered before and only pass through.
    """
    import pyarrow as pa

    shard, arrays = None, None
    for batch in batches:
        n = batch.num_rows
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        is_probe = batch.column("probe").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (is_probe[1:] != is_probe[:-1])])
        for lo, hi in zip(edges, [*edges[1:], n]):
            if not is_probe[lo]:
                shard, arrays = shards[lo], Arrays.read([batch.column(f"p{i}")[int(lo)].as_py() for i in range(6)])
                continue
            piece = batch.slice(lo, hi - lo)
            ids, h1 = piece.column("id"), piece.column("h1").to_numpy(zero_copy_only=False)
            if shards[lo] < 0:
                gone = np.arange(len(h1))
            elif shard != shards[lo]:
                continue  # a shard without keys
            else:
                has = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
                own = ids.fill_null(0).to_numpy(zero_copy_only=False)
                gone = np.flatnonzero(arrays.probe(h1.view(np.uint64), piece.column("h2").to_numpy(zero_copy_only=False).view(np.uint64), own, has, min_docs)[1])
            if len(gone):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(gone)), pa.array(h1[gone])], ["id", "h"])


def _rebuild(rows: Iterator[dict], min_chars: int, carry: int) -> Iterator[tuple]:
    for row in rows:
        lines = (row["text"] or b"").split(b"\n")
        kept = lines
        if row["drop"]:
            gone = set(row["drop"])
            kept = [x for x in lines if (h := line_hash(x, min_chars)) is None or h[0] not in gone]
        yield (row["id"], b"\n".join(kept).decode("utf-8", "replace"), len(lines), len(lines) - len(kept), *(row[f"c{i}"] for i in range(carry)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Drop lines whose key is long and found in many documents, except in the largest id holding it.

    Returns id_col, text_col (the lines that stay), n_lines, n_dropped, then the carried columns. A key is the
    line without white space at its ends, ASCII lower-cased.

    Defined cases: null and empty texts are one empty line; each row counts as a document, so a repeated row
    counts again, and all rows with the largest id keep the line; a null id is smaller than any other, and where
    only null ids hold a key it stays; a text of any length is one row; an empty table gives an empty one;
    columns that are not named are ignored, and a carried column named like a result column is left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    carry = tuple(c for c in carry if c not in (id_col, text_col, "n_lines", "n_dropped"))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    counted = map_rows(src, lambda rows: _count_lines(rows, min_chars), f"h1 long, h2 long, n long, last {id_type}")
    keys = counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where("n >= 2")
    keys = scratch.save(keys, "keys")
    some, probed = keys.agg(F.count("*"), F.sum("n")).first()
    least = (probed or 0) // _HOT
    top = keys.where(F.col("n") > least).collect() if probed else []  # fewer than _HOT rows
    unsigned = lambda v: np.array(v, np.int64).view(np.uint64)
    hot = Arrays.build(unsigned([r["h1"] for r in top]), unsigned([r["h2"] for r in top]), np.array([r["n"] for r in top], np.int64), [r["last"] for r in top]).parts()
    # shards of about as many keys, and as many probes, as one task should have
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-some // _KEYS_PER_SHARD), -(-(probed or 0) // _PROBES_PER_SHARD))
    shard_of = F.pmod(F.xxhash64("h1"), F.lit(shards)).cast("int").alias("shard")

    arrays = ", ".join(f"p{i} binary" for i in range(6))
    index = keys.where(F.col("n") <= least).select(shard_of, "h1", "h2", "n", "last").groupBy("shard").applyInPandas(_build_shard, f"shard int, {arrays}")
    index = scratch.save(index, "index")
    blobs = index.select("shard", F.lit(0).alias("salt"), F.lit(False).alias("probe"), F.lit(None).cast(id_type).alias("id"),
                         F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), *[f"p{i}" for i in range(6)])

    def probes_of(rows: Iterator[dict]) -> Iterator[tuple]:
        common, held = Arrays.read(hot), []

        def answer() -> Iterator[tuple]:
            h = np.array([x[1:] for x in held], np.int64).view(np.uint64)
            own, has = np.array([x[0] or 0 for x in held], np.int64), np.array([x[0] is not None for x in held])
            here, gone = common.probe(h[:, 0], h[:, 1], own, has, min_docs)
            for k in np.flatnonzero(gone | ~here).tolist():
                yield bool(here[k]), *held[k]
            held.clear()

        for row in rows:
            held += [(row["id"], *h) for h in {line_hash(x, min_chars) for x in (row["text"] or b"").split(b"\n")} - {None}]
            if len(held) >= _TOGETHER:
                yield from answer()
        if held:
            yield from answer()

    probes = map_rows(src, probes_of, f"hot boolean, id {id_type}, h1 long, h2 long")
    probes = probes.select(F.when(F.col("hot"), -1).otherwise(shard_of).alias("shard"), F.when(F.col("hot"), F.pmod(F.xxhash64("id", "h1"), F.lit(1 << 20)).cast("int")).otherwise(0).alias("salt"),
                           F.lit(True).alias("probe"), "id", "h1", "h2", *[F.lit(None).cast("binary").alias(f"p{i}") for i in range(6)])
    routed = blobs.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "probe")
    hits = routed.mapInArrow(lambda b: _probe(b, min_docs), f"id {id_type}, h long")
    drops = hits.groupBy(F.col("id").alias("drop_id")).agg(F.collect_set("h").alias("drop"))

    full = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    joined = full.join(drops, F.col("id").eqNullSafe(F.col("drop_id")), "left").drop("drop_id")
    to = with_fields(f"id {id_type}, text string, n_lines long, n_dropped long", docs, carry)
    out = map_rows(joined, lambda rows: _rebuild(rows, min_chars, len(carry)), to)
    return out.toDF(id_col, text_col, "n_lines", "n_dropped", *carry)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.*, c.k IS NOT NULL AND c.last <> d.doc_id AS gone FROM keyed d LEFT JOIN common c ON c.k = d.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
