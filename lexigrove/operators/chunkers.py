"""Chunkers and tokenisers by name, so that a configuration can choose and others can be added."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.operators import chunking, semantic


@dataclass(frozen=True)
class Tokenizer:
    """Two functions of columns: a text's tokens, and the text of tokens; the rest follows from them."""

    tokens: Callable[[Column], Column]
    text: Callable[[Column], Column]

    def count(self, c) -> Column:
        return F.size(self.tokens(X.text_of(c)))

    def first(self, c, n: int) -> Column:
        return self.text(F.slice(self.tokens(X.text_of(c)), 1, n))

    def last(self, c, n: int) -> Column:
        return X.once(self.tokens(X.text_of(c)), lambda t: self.text(F.slice(t, F.greatest(F.size(t) - n, F.lit(0)) + 1, F.lit(n))))

    def windows(self, c, size: int, overlap: int) -> Column:
        """An array of (start, text, tokens) of windows, none for a text without tokens."""
        one = lambda t, at: F.struct(at.cast("long").alias("start"), self.text(F.slice(t, at + 1, F.lit(size))).alias("content"), F.least(F.size(t) - at, F.lit(size)).cast("long").alias("tokens"))
        return X.once(self.tokens(X.text_of(c)), lambda t: F.when(F.size(t) > 0, F.transform(chunking.starts(F.size(t), size, overlap), lambda at: one(t, at))))


_TOKENIZERS: dict[str, Tokenizer] = {}
_CHUNKERS: dict[str, Callable[..., DataFrame]] = {}


def _named(kind: str, known: dict, name: str):
    key = name.strip().lower().replace("-", "_")
    if key not in known:
        raise ValueError(f"no {kind} {name!r}; there are {', '.join(sorted(known))}")
    return known[key]


def register_tokenizer(name: str, made: Tokenizer) -> None:
    key = name.strip().lower().replace("-", "_")
    if not key or key in _TOKENIZERS:
        raise ValueError(f"tokeniser {name!r} is blank or there already")
    _TOKENIZERS[key] = made


def tokenizer(name: str) -> Tokenizer:
    return _named("tokeniser", _TOKENIZERS, name)


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Makes a function of (docs, id_col, text_col, settings as keywords) known; it returns (id, chunk_index, content, ...)."""

    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name.strip().lower().replace("-", "_")
        if not key or key in _CHUNKERS:
            raise ValueError(f"chunker {name!r} is blank or there already")
        _CHUNKERS[key] = fn
        return fn

    return keep


def chunk(name: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, strategy, chunk_index, chunk_id, content) by a chunker's name. Settings that it does not know, and an overlap that
    is not less than the size, fail. A chunk's id is a digest of document, strategy, settings, place and content."""
    fn = _named("chunker", _CHUNKERS, name)
    known = set(inspect.signature(fn).parameters) - {"docs", "id_col", "text_col"}
    if unknown := sorted(set(settings) - known):
        raise ValueError(f"chunker {name!r} has no setting {', '.join(unknown)}; it has {', '.join(sorted(known))}")
    size, overlap = settings.get("size"), settings.get("overlap")
    if size is not None and (size < 1 or not 0 <= (overlap or 0) < size):
        raise ValueError("size must be positive, overlap at least 0 and less than size")
    told = ",".join(f"{k}={v}" for k, v in sorted(settings.items()) if not callable(v))
    made = fn(docs, id_col, text_col, **settings)
    identity = F.concat_ws("|", F.col(id_col).cast("string"), F.lit(name), F.lit(told), F.col("chunk_index").cast("string"), "content")
    return made.select(id_col, F.lit(name).alias("strategy"), F.col("chunk_index").cast("long").alias("chunk_index"), F.concat(F.lit("chunk_"), F.sha2(identity, 256)).alias("chunk_id"), "content")


register_tokenizer("whitespace", Tokenizer(X.tokens, lambda t: F.array_join(t, " ")))
register_tokenizer("characters", Tokenizer(lambda c: F.filter(F.split(c, ""), lambda x: x != ""), lambda t: F.array_join(t, "")))
register_tokenizer("terms", Tokenizer(X.index_terms, lambda t: F.array_join(t, " ")))


@register("fixed_size")
def fixed_size(docs: DataFrame, id_col: str, text_col: str, size: int = 256, overlap: int = 32, tokens: str = "whitespace") -> DataFrame:
    """Windows of any tokeniser's tokens."""
    cut = docs.select(id_col, F.posexplode(tokenizer(tokens).windows(F.col(text_col), size, overlap)).alias("chunk_index", "w"))
    return cut.select(id_col, "chunk_index", "w.content", "w.tokens")


@register("fixed_characters")
def fixed_characters(docs: DataFrame, id_col: str, text_col: str, size: int = 1024, overlap: int = 204) -> DataFrame:
    return chunking.fixed_characters(docs, size, overlap, id_col, text_col)


@register("recursive")
def recursive(docs: DataFrame, id_col: str, text_col: str, size: int = 128, overlap: int = 16) -> DataFrame:
    return chunking.recursive(docs, size, overlap, id_col, text_col)


@register("semantic")
def semantic_by_likeness(docs: DataFrame, id_col: str, text_col: str, size: int = 128, overlap: int = 0, least: int = 16, threshold: float = 0.65, encoder: semantic.Maker = semantic.hash_encoder()) -> DataFrame:  # noqa: B008
    return semantic.semantic_chunks(semantic.as_blocks(docs, id_col, text_col), encoder, size, overlap, least, threshold, id_col)


@register("semantic_percentile")
def semantic_by_percentile(docs: DataFrame, id_col: str, text_col: str, percentile: float = 0.95, encoder: semantic.Maker = semantic.hash_encoder()) -> DataFrame:  # noqa: B008
    return semantic.percentile_chunks(semantic.as_blocks(docs, id_col, text_col), encoder, percentile, id_col=id_col)
