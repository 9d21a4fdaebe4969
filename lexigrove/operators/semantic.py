"""Encoders, and chunks of documents where the meaning turns.

An encoder is made once in each task (`Maker`) and gets texts in batches across documents. Its vectors are checked and
brought to length 1. Semantic chunks are made of units, which are rows: sentences, cut into windows of tokens where they
are too long; code and tables are cut by tokens alone. A unit's likeness to the one before is a window over its
document. Where a chunk has to keep to a size, units are packed in order as sorted rows stream by; where it has none,
breaks are a running sum.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.window import Window

from lexigrove.functions import text as X
from lexigrove.functions.vectors import dot
from lexigrove.sources.shared import small_batches

Encoder = Callable[[list[str]], np.ndarray]
Maker = Callable[[], Encoder]


@lru_cache(100_000)
def _place(term: str) -> int:
    """32 bits of a term's checksum: the lower ones say where it counts, and one whether up or down."""
    return int.from_bytes(hashlib.md5(term.encode()).digest()[:4], "big")


def hash_encoder(width: int = 64) -> Maker:
    """A deterministic stand-in for a model: signed counts of hashed terms, and a last component of 1, so that no vector is zero."""
    word = re.compile(r"[^\W_]+")
    folded = str.maketrans(X.ACCENTED, X.PLAIN)

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            terms = [word.findall(t.lower() if t.isascii() else t.lower().translate(folded)) for t in texts]
            sizes = np.array([len(t) for t in terms], np.int64)
            h = np.fromiter(map(_place, chain.from_iterable(terms)), np.int64, int(sizes.sum()))
            cells = np.repeat(np.arange(len(texts)), sizes) * (width + 1) + h % width
            out = np.bincount(cells, np.where(h >> 16 & 1, 1.0, -1.0), len(texts) * (width + 1)).reshape(len(texts), width + 1)
            out[:, width] = 1.0
            return out

        return encode

    return make


def checked(vectors: np.ndarray, rows: int, dimension: int | None) -> np.ndarray:
    """Vectors at length 1. A wrong shape, components that are no finite numbers and zero vectors fail."""
    x = np.asarray(vectors, np.float64)
    if x.ndim != 2 or len(x) != rows or (dimension is not None and x.shape[1] != dimension):
        raise ValueError(f"an encoder returned shape {x.shape} for {rows} texts" + (f" and dimension {dimension}" if dimension else ""))
    if not np.isfinite(x).all():
        raise ValueError("an encoder returned components that are no finite numbers")
    length = np.sqrt((x * x).sum(1, keepdims=True))
    if (length == 0).any():
        raise ValueError("an encoder returned a zero vector")
    return x / length


def _vectors(column: pa.Array, encoder: Encoder, dimension: int | None, batch: int, prefix: str) -> Iterator[np.ndarray]:
    """The checked vectors of a column of texts, `batch` texts at a time."""
    for at in range(0, len(column), batch):
        texts = [(t or "").strip() for t in column.slice(at, batch).to_pylist()]
        if not all(texts):
            raise ValueError("an empty text can't be encoded")
        yield checked(encoder([prefix + t for t in texts]), len(texts), dimension)


def encode(rows: DataFrame, text_col: str, make: Maker, out_col: str = "vector", dimension: int | None = None, batch: int = 32, prefix: str = "") -> DataFrame:
    """rows with the vector of each text, `batch` texts at a time; texts are stripped and take the prefix. An empty one fails."""
    shape = StructType([*rows.schema.fields]).add(out_col, ArrayType(DoubleType()))
    to = to_arrow_schema(shape)
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for part in batches:
            encoder = encoder or make()
            found = list(_vectors(part.column(text_col), encoder, dimension, batch, prefix))
            if found:
                ends = np.cumsum([0, *(x.shape[1] for x in found for _ in range(len(x)))])
                vector = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x.ravel() for x in found])))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*part.columns, vector], to)], schema=to)

    return rows.mapInArrow(run, shape)


def embed_questions(questions: DataFrame, make: Maker, dimension: int | None = None, prefix: str = "query: ") -> DataFrame:
    """questions(query_id, question) to (query_id, query_vector). A blank question fails, as do vectors that `checked` turns down."""
    return encode(questions.select("query_id", "question"), "question", make, "query_vector", dimension, prefix=prefix).select("query_id", "query_vector")


def units(blocks: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """blocks(id, block_index, block_type, text) to (id, unit, block_index, text, tokens), numbered within the document."""
    whole = F.col("block_type").isin("code", "table")
    text = X.text_of("text")
    cut = blocks.select(id_col, "block_index", F.posexplode(F.when(whole, F.array(X.strip(text))).otherwise(X.sentences(text))).alias("s", "sentence"))
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " "))
    # tokens are counted once, and again only where a sentence is cut
    cut = cut.withColumn("many", X.token_count("sentence").cast("long"))
    parts = F.when(F.col("many") > size, X.once(X.tokens(F.col("sentence")), windows)).when(F.col("many") > 0, F.array("sentence")).otherwise(F.array().cast("array<string>"))
    cut = cut.select(id_col, "block_index", "s", "many", F.posexplode(parts).alias("w", "text"))
    cut = cut.select(id_col, "block_index", "s", "w", "text", F.when(F.col("many") <= size, F.col("many")).otherwise(X.token_count("text").cast("long")).alias("tokens"))
    order = Window.partitionBy(id_col).orderBy("block_index", "s", "w")
    return cut.select(id_col, (F.row_number().over(order) - 1).alias("unit"), "block_index", "text", "tokens")


def alike(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Encoded units with `similarity` to the unit before, null for the first; vectors go."""
    before = F.lag("vector").over(Window.partitionBy(id_col).orderBy("unit"))
    return encoded.withColumn("before", before).select(id_col, "unit", "block_index", "text", "tokens", F.when(F.col("before").isNotNull(), F.round(dot(F.col("vector"), F.col("before")), 6)).alias("similarity"))


def likened(blocks: DataFrame, size: int, make: Maker, id_col: str = "doc_id", dimension: int | None = None, batch: int = 32) -> DataFrame:
    """The blocks' units with `similarity` to the unit before, null for a document's first. A document's units come one after
    the other, in order, and stay where they are: a vector is compared with the one before it where it is made, and only
    the last of a batch is held."""
    ready = units(blocks, size, id_col).sortWithinPartitions(id_col, "unit")  # dealt out by document
    shape = StructType([*ready.schema.fields]).add("similarity", DoubleType())
    to = to_arrow_schema(shape)
    small_batches(ready.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = last = None
        for part in batches:
            if not part.num_rows:
                continue
            encoder = encoder or make()
            x = np.concatenate(list(_vectors(part.column("text"), encoder, dimension, batch, "")))
            unit = part.column("unit").to_numpy()
            before = np.concatenate([x[:1] if last is None else last, x[:-1]])  # a document's first has none
            like = np.cumsum(x * before, 1)[:, -1]  # summed in order, as dot() does
            last = x[-1:].copy()
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*part.columns, pa.array(like, mask=unit == 0)], to)], schema=to)

    return ready.mapInArrow(run, shape).withColumn("similarity", F.round("similarity", 6))


def as_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A document's text as one paragraph."""
    return docs.select(id_col, F.lit(0).cast("long").alias("block_index"), F.lit("paragraph").alias("block_type"), F.col(text_col).alias("text"))


def semantic_chunks(
    blocks: DataFrame, make: Maker, size: int = 128, overlap: int = 0, least: int = 16, threshold: float = 0.65, id_col: str = "doc_id", dimension: int | None = None,
) -> DataFrame:
    """(id, chunk_index, token_count, overlap_tokens, boundary, least_similarity, first_unit, last_unit, content).

    Units are taken in order. A chunk ends before a unit that is less like the last one than `threshold`, if it has at
    least `least` tokens, or with which it would have more than `size` tokens. The last `overlap` tokens begin the next
    chunk if they fit with its first unit. boundary says why a chunk ended; least_similarity is the smallest likeness of
    neighbours inside it, null for one unit. A chunk like the one before it is left out. Documents without units have
    no chunks.
    """
    if size < 1 or not 0 <= overlap < size or not -1.0 <= threshold <= 1.0:
        raise ValueError("size must be positive, overlap at least 0 and less than size, threshold between -1 and 1")
    ready = likened(blocks, size, make, id_col, dimension)
    shape = StructType([blocks.schema[id_col], *StructType.fromDDL("chunk_index long, token_count long, overlap_tokens long, boundary string, least_similarity double, first_unit long, last_unit long, content string")])
    to = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack(size, overlap, least, threshold)
        for batch in batches:
            out = [row for r in batch.to_pylist() for row in pack.add(r[id_col], r["unit"], r["text"], r["tokens"], r["similarity"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)
        if out := list(pack.end("document_end")):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)

    return ready.mapInArrow(run, shape)


class _Pack:
    """Units of one document after another into chunks."""

    def __init__(self, size: int, overlap: int, least: int, threshold: float):
        self.size, self.overlap, self.least, self.threshold = size, overlap, least, threshold
        self.doc, self.index, self.last = None, 0, None
        self._start()

    def _start(self) -> None:
        self.parts: list[str] = []
        self.units: list[int] = []
        self.likes: list[float] = []
        self.count = self.carried = 0

    def end(self, why: str) -> Iterator[tuple]:
        if self.units:
            text = " ".join(self.parts)
            if text != self.last:
                yield (self.doc, self.index, self.count, self.carried, why, min(self.likes, default=None), self.units[0], self.units[-1], text)
                self.index, self.last = self.index + 1, text

    def add(self, doc, unit: int, text: str, tokens: int, like: float | None) -> Iterator[tuple]:
        if doc != self.doc:
            yield from self.end("document_end")
            self.doc, self.index, self.last = doc, 0, None
            self._start()
        turned = bool(self.units) and like is not None and like < self.threshold and self.count >= self.least
        if turned or (self.units and self.count + tokens > self.size):
            yield from self.end("semantic_threshold" if turned else "chunk_size")
            tail = " ".join(self.parts).split()[-self.overlap :] if self.overlap else []
            self._start()
            if tail and len(tail) + tokens <= self.size:
                self.parts, self.count, self.carried = [" ".join(tail)], len(tail), len(tail)
        elif self.units and like is not None:
            self.likes.append(like)
        self.parts.append(text)
        self.units.append(unit)
        self.count += tokens


def percentile_chunks(blocks: DataFrame, make: Maker, percentile: float = 0.95, size: int = 128, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_index, units, least_similarity, content): chunks without a size of their own. A document breaks where two
    units are further apart than that percentile of its distances; which chunk a unit is in is a running sum of breaks."""
    ready = likened(blocks, size, make, id_col).withColumn("distance", F.round(1 - F.col("similarity"), 6))
    doc = Window.partitionBy(id_col)
    limit = ready.withColumn("limit", F.round(F.percentile("distance", percentile).over(doc), 6))  # a document's units
    broken = limit.withColumn("turn", F.coalesce(F.col("distance") > F.col("limit"), F.lit(False)))
    placed = broken.withColumn("chunk_index", F.sum(F.col("turn").cast("long")).over(doc.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.when(~F.col("turn"), F.col("similarity"))
    made = placed.groupBy(id_col, "chunk_index").agg(F.count("*").alias("units"), F.min(inside).alias("least_similarity"), F.sort_array(F.collect_list(F.struct("unit", "text"))).alias("held"))
    return made.select(id_col, "chunk_index", "units", "least_similarity", F.array_join("held.text", " ").alias("content"))
