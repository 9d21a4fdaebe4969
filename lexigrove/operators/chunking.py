"""Chunks of documents: fixed windows as expressions; packed and semantic chunks one document at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lexigrove.functions import text as X
from lexigrove.operators.percentiles import percentiles, with_percentiles
from lexigrove.sources.shared import kept, small_batches


def starts(length, size: int, overlap: int):
    """0, step, 2 step, ... until a window reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def fixed_characters(docs: DataFrame, size: int = 1024, overlap: int = 204, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, chunk_index, start, chunk_id, content, then the carried columns): windows of characters, stripped; blank ones
    take no index. A text is cut where it is read, in time in proportion to its length, and nothing is shuffled."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    src = docs.select(F.col(id_col).alias("id"), X.text_of(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    kind = StructType([StructField("id", src.schema["id"].dataType), *StructType.fromDDL("chunk_index long, start long, content string"), *[src.schema[f"c{i}"] for i in range(len(carry))]])
    to = to_arrow_schema(kind)
    small_batches(docs.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                last = max(-(-(len(text) - size) // (size - overlap)), 0)
                cut = ((at, text[at : at + size].strip()) for at in range(0, (last + 1) * (size - overlap), size - overlap))
                out += [(key, n, at, content, *rest) for n, (at, content) in enumerate(x for x in cut if x[1])]
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)

    cut = src.mapInArrow(windows, kind)
    name = F.concat(F.lit(f"fixed__{size}__"), F.col("id").cast("string"), F.lit("__chunk_"), F.col("chunk_index").cast("string"))
    return cut.select(F.col("id").alias(id_col), "chunk_index", "start", name.alias("chunk_id"), "content", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def fixed_tokens(docs: DataFrame, size: int = 256, overlap: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start, token_count, content, chunk_id): windows of white-space tokens."""
    part = lambda w, at: F.struct(at.cast("long").alias("start"), F.slice(w, at + 1, F.lit(size)).alias("part"))
    parts = X.once(X.tokens(F.col(text_col)), lambda w: F.when(F.size(w) > 0, F.transform(starts(F.size(w), size, overlap), lambda at: part(w, at))))
    cut = docs.select(id_col, F.posexplode(parts).alias("chunk_index", "p"))
    cut = cut.select(id_col, F.col("chunk_index").cast("long"), "p.start", F.size("p.part").cast("long").alias("token_count"), F.array_join("p.part", " ").alias("content"))
    identity = F.concat_ws("|", F.col(id_col).cast("string"), F.lit("fixed_size"), F.lit(str(size)), F.lit(str(overlap)), F.col("chunk_index").cast("string"), F.col("content"))
    return cut.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.sha2(identity, 256)))


def statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """Count, mean, median, extremes and population deviation of characters and words."""
    measured = kept(chunks.select(*by, F.length("content").alias("chars"), X.token_count("content").alias("words")), "chunk-sizes")
    each = lambda c: [F.round(F.avg(c), 4).alias(f"mean_{c}"), F.min(c).cast("long").alias(f"min_{c}"), F.max(c).cast("long").alias(f"max_{c}"), F.round(F.stddev_pop(c), 4).alias(f"std_{c}")]
    names = ("chars", "words")
    plain = measured.groupBy(*by).agg(F.count("*").alias("chunks"), *[x for c in names for x in each(c)])
    both = with_percentiles(plain, percentiles(measured, names, {"median": 0.5}, by), by)
    return both.select(*by, "chunks", *[f"{k}_{c}" for c in names for k in ("mean", "median", "min", "max", "std")])


def validation(chunks: DataFrame, size: int) -> DataFrame:
    """One row: empty, repeated, oversized and very short chunks."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_if(X.strip(F.col("content")) == "").alias("empty"), (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("repeated_ids"),
        F.count_if(F.length("content") > size).alias("oversized"), F.count_if(F.length("content") < 50).alias("short"),
    )


_CUTS = (r"\n\n+", r"\n", r"(?<=[.!?])\s+", r"(?<=;)\s+", r"(?<=,)\s+", r"\s+")


def units(text: str, size: int) -> Iterator[str]:
    """Pieces of at most `size` tokens, cut at the coarsest separator that does."""

    def cut(piece: str, level: int) -> Iterator[str]:
        words = piece.split()
        if len(words) <= size:
            if words:
                yield piece.strip()
        elif level == len(_CUTS):
            for i in range(0, len(words), size):
                yield " ".join(words[i : i + size])
        else:
            for part in re.split(_CUTS[level], piece):
                yield from cut(part, level + 1)

    return cut(text, 0)


def pack(parts: list[str], size: int, overlap: int, breaks: list[bool] | None = None, least: int = 0) -> Iterator[tuple[str, str]]:
    """(content, reason) of chunks filled in order; the end of a full chunk is carried into the next if it fits."""
    held: list[str] = []
    count, last, fresh = 0, None, False
    for i, part in enumerate(parts):
        words = part.split()
        split = bool(held) and fresh and breaks is not None and breaks[i] and count >= least
        if held and (split or count + len(words) > size):
            text = " ".join(held)
            if text != last and fresh:
                yield text, "semantic_threshold" if split else "chunk_size"
                last = text
            tail = text.split()[-overlap:] if overlap else []
            held, count = ([" ".join(tail)], len(tail)) if tail and len(tail) + len(words) <= size else ([], 0)
            fresh = False
        held.append(part)
        count, fresh = count + len(words), True
        if count == size:
            text = " ".join(held)
            if text != last:
                yield text, "chunk_size"
                last = text
            held, count, fresh = [], 0, False
    if held and fresh and (text := " ".join(held)) != last:
        yield text, "document_end"


def _by_document(docs: DataFrame, make, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    shape = StructType([docs.schema[id_col], *StructType.fromDDL("chunk_index long, token_count long, boundary string, content string")])
    to = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                out += ((key, n, len(c.split()), why, c) for n, (c, why) in enumerate(make(batch.column(1)[i].as_py() or "")))
                if len(out) >= 1000 or out and i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)
                    out = []

    return docs.select(id_col, text_col).mapInArrow(run, shape)


def recursive(docs: DataFrame, size: int = 128, overlap: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units by separators, packed in order."""
    return _by_document(docs, lambda t: pack(list(units(t, size)), size, overlap), id_col, text_col)
