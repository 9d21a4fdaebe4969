"""MinHash near-dedup: fast similarity sketches, banding, and verification on full shingle sets.

1. Each document becomes a set of hashed 5-word shingles and a sketch of fixed size. The sketch is filled in rounds:
   in each, every element is hashed to one bin; a bin keeps the least (round, value). After as many rounds as there
   are bins, bin i takes the least of all elements in round t + i, so every coordinate is filled; the number of equal
   coordinates concentrates about the Jaccard similarity as t independent MinHashes would.
2. Documents with equal sets are one class. Classes meet in buckets, one for each band of the sketch; a bucket of any
   size is dealt over tasks by range.
3. In a bucket, members in order of set size are paired with the first and with the one before, not all with all.
   Pairs whose sizes and sketches allow a link are verified on full sets, and linked ones joined to components.
4. Buckets of four or more that still hold several components are settled: members outside a bucket's largest
   component meet all others, in pairs of blocks of bounded size, and full sets are compared inside the task. Only
   links that join components leave it, so no link that bucket members could have between components is lost,
   while a group of near copies costs a few rows a member and no pairs.

A sketch allows a link unless its equal coordinates fall short of the threshold's expectation by 6.5 standard
deviations, which a linked pair does less often than it misses all bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import Scratch, components, documents, join_hot, map_rows

_U = np.uint64
_BLOCK, _BLOCK_SHINGLES = 2048, 4_000_000
_MULT = tuple(_U(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    """Hashed word shingles of a text; hashes of words are kept, within a bound."""

    def __init__(self, width: int = 5):
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """Distinct shingle hashes, sorted."""
        return self.of_words(text.lower().split())

    def of_words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        hashed = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= 64:
                    known[w] = h
            hashed.append(h)
        if not hashed:
            return np.zeros(0, _U)
        x = np.array(hashed, _U)
        k = self.width
        if len(x) < k:  # the whole sequence is the one shingle
            return mix(np.array([xxhash.xxh64_intdigest(x.tobytes(), len(x))], _U))
        total = x[: len(x) - k + 1] * _MULT[0]
        for j in range(1, k):
            total = mix(total) + x[j : len(x) - k + 1 + j] * _MULT[j]
        return np.unique(mix(total))


def fast_sketch(x: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes: `bins` values, each (round << 32 | value)."""
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(bins, empty)
    at, block = 0, 1
    while at < bins:
        count = min(block, bins - at)
        rounds = np.arange(at, at + count, dtype=_U)[:, None]
        h = mix(x[None, :] + (rounds + _U(1)) * _U(0x9E3779B97F4A7C15))
        cell = ((h & _U(0xFFFFFFFF)) * _U(bins)) >> _U(32)
        np.minimum.at(out, cell.ravel().astype(np.int64), ((rounds << _U(32)) | (h >> _U(32))).ravel())
        at += count
        if not (out == empty).any():
            return out
        block = max(1, min(64, 4096 // len(x)))
    for i in np.flatnonzero(out == empty):
        h = mix(x + _U((bins + int(i) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        out[i] = (_U(bins + int(i)) << _U(32)) | (h >> _U(32)).min()
    return out


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    rows = sketch.reshape(bands, -1)
    total = mix(np.arange(bands, dtype=_U) + _U(1))
    for j in range(rows.shape[1]):
        total = mix(total ^ rows[:, j]) * _MULT[0] + _U(j)
    return total.view(np.int64)


_HEAD = -1  # in place of a pair's second node: the first member of a part of a bucket that may go on in another partition


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members in order of (bucket, size, node) in. Pairs with the first and the previous member out; members of
    buckets of four or more too, with the bucket. A bucket may reach over several partitions: of the partition's first
    and last one all members and the head are sent."""
    names = ["bucket", "n", "a", "b"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    sent: set = set()
    out: list[tuple] = []
    bucket, seen, first, last, outer = None, 0, [], None, True

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)

    def close(end: bool) -> None:
        if (outer or end) and first:
            out.append((bucket, *first[0], _HEAD))
            if seen < 4:
                out.extend((bucket, *x, None) for x in first)

    for batch in batches:
        for h, n, node in zip(*(batch.column(c).to_pylist() for c in ("h", "n", "node"))):
            if h != bucket:
                if bucket is not None:
                    close(False)
                    outer = False
                bucket, seen, first, last = h, 0, [], None
            seen += 1
            if last is not None:
                for other in {first[0][1], last}:
                    pair = (min(other, node), max(other, node))
                    if pair not in sent:
                        sent.add(pair)
                        out.append((None, None, *pair))
            if seen < 4:
                first.append((n, node))
            elif seen == 4:
                out += [(h, *x, None) for x in first]
            if seen >= 4:
                out.append((h, n, node, None))
            last = node
            if len(out) > 20_000:
                yield pack()
                out.clear()
        if len(sent) > 300_000:
            sent.clear()
    close(True)
    if out:
        yield pack()


def least_equal(coordinates: int, percent: int) -> int:
    """Equal coordinates below which a pair isn't verified."""
    p = percent / 100
    return int(coordinates * p - 6.5 * (coordinates * p * (1 - p)) ** 0.5)


def shared_counts(x: np.ndarray, values: np.ndarray, first: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """How many of x's elements each owner holds. owner[first[k] : first[k + 1]] hold the k-th of the sorted values."""
    k = np.minimum(np.searchsorted(values, x), len(values) - 1)
    k = k[values[k] == x]
    lo, size = first[k], first[k + 1] - first[k]
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(k) else np.zeros(0, np.int64)
    return np.bincount(owner[at], minlength=owners)


def _settle(pdf: pd.DataFrame, percent: int, width: int) -> pd.DataFrame:
    """One pair of blocks of a bucket: links that join components which nothing in this pair has joined before."""
    shingles, unzip = Shingles(width), zstandard.ZstdDecompressor()
    kind, i, j = (int(pdf[c].iloc[0]) for c in ("kind", "i", "j"))
    part = pdf["part"].to_numpy()
    left, right = (part == "o" + str(i), part == ("m" if kind else "o") + str(j))
    node, comp = pdf["a"].to_numpy(np.int64), np.unique(pdf["comp"].to_numpy(np.int64), return_inverse=True)[1]
    sets = [shingles.of_words(unzip.decompress(w).split()) for w in pdf["words"]]
    others = np.flatnonzero(right)
    out = []
    if len(others) and left.any():
        sizes = np.array([len(sets[k]) for k in others])
        values = np.concatenate([sets[k] for k in others])
        order = np.argsort(values, kind="stable")
        owner = np.repeat(np.arange(len(others)), sizes)[order]
        values, first = np.unique(values[order], return_index=True)
        first = np.append(first, len(owner))
        for k in np.flatnonzero(left):
            apart = comp[others] != comp[k]
            if not apart.any():
                continue
            both = shared_counts(sets[k], values, first, owner, len(others))
            for m in np.flatnonzero(apart & (100 * both >= percent * (sizes + len(sets[k]) - both))):
                if comp[others[m]] != comp[k]:
                    out.append((node[k], node[others[m]]))
                    comp[comp == comp[others[m]]] = comp[k]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


class NearDedup:
    """Settings, and the steps as tables in the shared folder."""

    def __init__(self, percent: int = 85, width: int = 5, bands: int = 36, rows: int = 6):
        self.percent, self.width, self.bands, self.rows = percent, width, bands, rows

    def classes(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n_shingles, cls, bands, sketch) for each row; cls is a digest of the set, null for an empty one; sketch
        has the last byte of each coordinate."""
        bands, rows, width = self.bands, self.rows, self.width

        def run(batch: Iterator[dict]) -> Iterator[tuple]:
            shingles = Shingles(width)
            for row in batch:
                x = shingles(row["text"] or b"")
                if len(x):
                    sketch = fast_sketch(x, bands * rows)
                    yield row["id"], len(x), xxhash.xxh3_128_digest(x.tobytes()), band_hashes(sketch, bands).tolist(), sketch.astype(np.uint8).tobytes()
                else:
                    yield row["id"], 0, None, None, None

        src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
        return map_rows(src, run, "id long, n_shingles long, cls binary, bands array<long>, sketch binary", flush=64)

    def words(self, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, words) for nodes (node, least, cls): the class's words, compressed."""
        width = self.width

        def pack(batch: Iterator[dict]) -> Iterator[tuple]:
            shingles, zip_ = Shingles(width), zstandard.ZstdCompressor(3)
            for row in batch:
                words = (row["text"] or b"").lower().split()
                x = shingles.of_words(words)
                if xxhash.xxh3_128_digest(x.tobytes()) == row["cls"]:  # else another row of the same id
                    yield row["node"], zip_.compress(b" ".join(words))

        texts = docs.join(nodes, F.col("id") == F.col("least")).select("node", "cls", "text")
        return map_rows(texts, pack, "node long, words binary").dropDuplicates(["node"])

    def verify(self, pairs: DataFrame, packed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are similar. Words travel once for each end of a pair."""
        percent, width = self.percent, self.width

        def check(batch: Iterator[dict]) -> Iterator[tuple]:
            shingles, unzip = Shingles(width), zstandard.ZstdDecompressor()
            held: tuple = (None, None)
            for row in batch:
                if held[0] != row["b"]:
                    held = (row["b"], shingles.of_words(unzip.decompress(row["y"]).split()))
                y = held[1]
                x = shingles.of_words(unzip.decompress(row["x"]).split())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    yield row["a"], row["b"]

        one = pairs.join(packed.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
        both = one.join(packed.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")
        return scratch.save(map_rows(both, check, "a long, b long"), f"{name}-links")

    def likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches allow a link."""
        least = least_equal(self.bands * self.rows, self.percent)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                    yield batch.filter(pa.array((x == y).sum(1) >= least)).select(["a", "b"])

        end = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        out = pairs.where("a < b").join(end("a"), "a").join(end("b"), "b").where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        return out.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct()

    def settle(self, big: DataFrame, comp: DataFrame, packed: DataFrame, scratch: Scratch) -> DataFrame:
        """Links (a, b) between components of one bucket. big: (bucket, a); comp: (id, component)."""
        percent, width = self.percent, self.width
        at = big.join(comp.withColumnRenamed("id", "a"), "a", "left").select("bucket", "a", "n", F.coalesce("component", "a").alias("comp"))
        at = scratch.save(at, "crowds")
        each = at.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("size"))
        each = each.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("size").alias("size"), F.max_by("size", F.struct("n", "comp")).alias("main_size"))
        # rows are dealt anew by (bucket, member): a bucket of any size spreads over tasks
        # blocks are bounded by members and, as sets may be large, by the shingles of all their members
        blocks = lambda n, size: F.greatest(F.ceil(n / _BLOCK), F.ceil(size / _BLOCK_SHINGLES)).cast("int")
        all_, most, size, main = (F.col(c) for c in ("all", "most", "size", "main_size"))
        each = scratch.save(each.where("all > most").select("bucket", "main", "all", blocks(most, main).alias("mains"), blocks(all_ - most, size - main).alias("outs")), "split")
        at = join_hot(at.drop("n"), each, ["bucket"], "all").withColumn("out", F.col("comp") != F.col("main"))
        at = at.withColumn("blk", F.pmod(F.xxhash64("a"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("mains"))).cast("int"))
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        b = F.col("blk")
        meets = F.when(F.col("out"), F.concat(F.transform(every("outs"), lambda x: pair(0, F.least(b, x), F.greatest(b, x))), F.transform(every("mains"), lambda x: pair(1, b, x)))).otherwise(
            F.transform(every("outs"), lambda x: pair(1, x, b))
        )
        met = at.select("bucket", "a", "comp", F.concat(F.when(F.col("out"), "o").otherwise("m"), b.cast("string")).alias("part"), F.explode(meets).alias("meet"))
        met = met.join(packed.withColumnRenamed("node", "a"), "a").select("bucket", "meet.*", "a", "comp", "part", "words")
        found = met.groupBy("bucket", "kind", "i", "j").applyInPandas(lambda p: _settle(p, percent, width), "a long, b long")
        return scratch.save(found.distinct(), "settled")

    def __call__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id_col, n_shingles, component_id, kept) for each row.

        Defined cases: a text without words is linked with nothing, and so is a row without an id, which has no
        component_id and is kept; fewer than five words are one shingle; rows that repeat an id count as one
        document, with all links that their texts have, and all are kept if that id is its component's smallest; a
        text of any length is one row and one set; an empty table gives an empty one; columns that are not named are
        ignored. Ids are integers.
        """
        spark = docs.sparkSession
        scratch = Scratch(spark, "near")
        src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
        rows = scratch.save(self.classes(docs, id_col, text_col), "rows")
        usable = rows.where("cls is not null and id is not null")
        nodes = usable.groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed once it is written

        members = nodes.select("node", "n", F.explode("bands").alias("h"))
        pairs = lambda dealt: dealt.sortWithinPartitions("h", "n", "node").mapInArrow(_pair_up, "bucket long, n long, a long, b long")
        # by range, so that a bucket of any size spreads over tasks; heads, at most two for each partition, join its parts
        met = scratch.save(pairs(members.repartitionByRange("h", "n", "node")), "met")
        heads = pairs(met.where(F.col("b") == _HEAD).select(F.col("bucket").alias("h"), "n", F.col("a").alias("node")).repartition("h"))
        near = met.where("bucket is null").unionByName(heads.where("bucket is null"))
        tried = scratch.save(self.likely(near.select("a", "b").distinct(), nodes), "pairs-0")
        big = met.where("bucket is not null and b is null").select("bucket", "a", "n")
        ends = tried.select("a").union(tried.select("b")).union(big.select("a")).distinct()
        packed = scratch.save(self.words(src, ends.join(nodes.select("node", "least", "cls"), F.col("a") == F.col("node")).select("node", "least", "cls")), "words")
        links = self.verify(tried, packed, scratch, "links-0")
        # rows that share an id are one document: their classes are linked
        named = nodes.select("cls", "node", "copies")
        shared = join_hot(usable.select("id", "cls"), named, ["cls"], "copies").groupBy("id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where("size(all) > 1")
        shared = shared.select("a", F.explode("all").alias("b")).where("a <> b")
        comp = scratch.save(components(links.union(shared), scratch, "comp-0"), "comp-0")

        found = self.settle(big, comp, packed, scratch)
        up = lambda end: comp.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        joined = found.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        wider = scratch.save(components(joined, scratch, "comp-1"), "wider")
        risen = comp.join(wider.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        comp = scratch.save(risen.union(wider.join(comp.select("id"), "id", "left_anti").select("id", "component")), "comp-1")

        placed = nodes.join(comp, F.col("node") == F.col("id"), "left").select("cls", "least", "copies", F.coalesce("component", "node").alias("root"))
        placed = scratch.save(placed, "placed")
        roots = placed.groupBy("root").agg(F.count("*").alias("classes"), F.min("least").alias("component_id"))
        placed = scratch.save(join_hot(placed, roots, ["root"], "classes").select("cls", "copies", "component_id"), "components")
        out = join_hot(rows.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")), placed, ["cls"], "copies", "left")
        component = F.coalesce("component_id", "id")
        return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return NearDedup()(documents(spark, sf_dir))


ORACLE = {
    "op8_near_dedup": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM worded),
sized AS MATERIALIZED (SELECT doc_id, s, len(s)::BIGINT AS n FROM shingled),
flat AS (SELECT doc_id, n, hash(unnest(s)) AS x FROM sized),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sized s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n"""
}
