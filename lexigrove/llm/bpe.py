"""Byte-level BPE encoding and decoding with overlapping chunks.

Every text is cut into chunks that overlap, and all chunks are treated alike:

1. a chunk is split into pre-tokens on its own, from its overlap on, and reports where pre-tokens begin in the
   overlaps with its two neighbours;
2. neighbours are stitched at the first place in their overlap that both have as a boundary, with white space after
   it and none before it: from such a place on, the splitting no longer depends on what came before, and a text cut
   there splits as it did whole;
3. what lies between two stitches is encoded, and the pieces' ids are put together in order. Neighbours that never
   agree (one pre-token longer than their overlap) stay one piece.

The chunks of a text up to `spread` characters are worked off one after the other in the task that reads it. Longer
texts are first cut into stretches of that length, with the same overlaps and stitches, which are dealt to tasks; a
long text that occurs more than once is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexigrove.llm.common import Scratch, documents, map_rows

#: Fixed value: the public vocabulary's splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = frozenset(" \t\n\r")


class Codec:
    """Ranks read once in each worker."""

    _open: dict[str, Codec] = {}

    def __init__(self, ranks_path: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("lexigrove", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def boundaries(self, part: str) -> list[int]:
        """Places in part where a pre-token begins with white space after something else."""
        return [x for x in accumulate(map(len, self.split(part))) if x < len(part) and part[x] in _SPACE and not part[x - 1].isspace()]

    def pieces(self, text: str, chunk: int, overlap: int) -> Iterator[str]:
        """text in pieces that split as they do in the whole."""
        start, tail = 0, set()  # where the open piece begins, and the last chunk's boundaries in its overlap with this one
        for left in range(0, max(len(text), 1), chunk):
            lo, right = max(0, left - overlap), left + chunk
            found = [lo + x for x in self.boundaries(text[lo : right + overlap])]
            cut = next((x for x in found if x in tail), None) if left else None
            if cut is not None and cut > start:
                yield text[start:cut]
                start = cut
            tail = {x for x in found if x > right - overlap}
        yield text[start:]

    def encode(self, text: str, chunk: int, overlap: int) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the bytes that they stand for."""
        encode, decode = self.bpe.encode_ordinary, self.bpe.decode_bytes
        ids = [encode(p) for p in self.pieces(text, chunk, overlap)]
        return b"".join([np.array(x, "<u4").tobytes() for x in ids]), b"".join(map(decode, ids))


def encode_texts(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1024, overlap: int = 128, spread: int = 262_144
) -> DataFrame:
    """(id_col, n_tokens, ids, decoded): ids are packed little-endian 32-bit integers, decoded the bytes they stand for.

    The rank file must lie at ranks_path on every executor (it comes with an installed package).

    Defined cases: null and empty texts have no ids; a repeated row comes out as often as it goes in; a null id
    is carried along; a text of any length is cut into chunks, and one over `spread` characters is shared out; a
    run without white space of any length is one piece, as its bytes are merged as a whole; strings that look like
    special tokens are plain text; an empty table gives an empty one; columns that are not named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "bpe")
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = T.StructType.fromDDL("n_tokens long, ids binary, decoded binary")

    def whole(rows: Iterator[dict]) -> Iterator[tuple]:
        codec = Codec.at(ranks_path)
        for row in rows:
            ids, decoded = codec.encode(row["text"], chunk, overlap)
            yield row["id"], len(ids) // 4, ids, decoded

    short = map_rows(src.where(F.length("text") <= spread), whole, T.StructType([T.StructField("id", src.schema["id"].dataType), *coded]))

    long = src.where(F.length("text") > spread).select("id", "text", F.sha2("text", 256).alias("key"))
    owners = scratch.save(long.select("id", "key"), "owners")
    texts = scratch.save(long.select("key", "text").dropDuplicates(["key"]), "texts")
    margin = max(overlap, min(spread // 4, 4096))

    def stretches(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            text = row["text"]
            for nth, left in enumerate(range(0, len(text), spread)):
                lo = max(0, left - margin)
                yield row["key"], nth, lo, text[lo : left + spread + margin]

    cut = scratch.save(map_rows(texts, stretches, "key string, nth int, start long, part string"), "stretches")
    cut = cut.repartition("key", "nth")

    def ends(rows: Iterator[dict]) -> Iterator[tuple]:
        codec = Codec.at(ranks_path)
        for row in rows:
            found = [row["start"] + x for x in codec.boundaries(row["part"])]
            left, right = row["nth"] * spread, (row["nth"] + 1) * spread
            yield row["key"], row["nth"], [x for x in found if left - margin < x < left + margin], [x for x in found if right - margin < x < right + margin]

    edges = map_rows(cut, ends, "key string, nth int, head array<long>, tail array<long>")
    along = Window.partitionBy("key").orderBy("nth")
    stitch = F.when(F.col("nth") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(along))))
    edges = edges.select("key", "nth", stitch.alias("lo"))
    # stretches without a stitch go on with the piece before
    edges = edges.withColumn("piece", F.count("lo").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ahead = along.rowsBetween(1, Window.unboundedFollowing)
    edges = scratch.save(edges.select("key", "nth", "piece", "lo", F.first("lo", True).over(ahead).alias("hi")), "edges")

    def encode(rows: Iterator[dict]) -> Iterator[tuple]:
        codec = Codec.at(ranks_path)
        for row in rows:
            parts, at = [], row["lo"]
            for p in row["parts"]:
                parts.append(p["part"][at - p["start"] :])
                at = p["start"] + len(p["part"])
            text = "".join(parts)
            ids, decoded = codec.encode(text if row["hi"] is None else text[: row["hi"] - row["lo"]], chunk, overlap)
            yield row["key"], row["piece"], ids, decoded

    joined = cut.join(edges, ["key", "nth"]).groupBy("key", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("nth", "start", "part"))).alias("parts"))
    encoded = map_rows(joined, encode, "key string, piece long, ids binary, decoded binary")
    each = encoded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("all"))

    def together(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            ids = b"".join([p["ids"] for p in row["all"]])
            yield row["key"], len(ids) // 4, ids, b"".join([p["decoded"] for p in row["all"]])

    each = map_rows(each, together, T.StructType([T.StructField("key", T.StringType()), *coded]))
    long_out = owners.join(each, "key").select("id", "n_tokens", "ids", "decoded")
    return short.unionByName(long_out).withColumnRenamed("id", id_col)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode_texts(documents(spark, sf_dir), vocabulary()))
