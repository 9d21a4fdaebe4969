"""Search over a corpus for a whole set of questions at once: lexical, vector, fused, reranked.

Scores are rounded to six decimals before ranking and every order ends with an id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lexigrove.functions import text as X
from lexigrove.operators.lexical import Index, bm25, build_index  # noqa: F401 - both engines are to be had here
from lexigrove.sources.shared import kept, small_batches

def ranked(scored: DataFrame, top: int, *order: Column) -> DataFrame:
    """The best `top` of each query, numbered from 1."""
    w = Window.partitionBy("query_id").orderBy(*order)
    out = scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return out.select("query_id", "rank", *[c for c in scored.columns if c != "query_id"])


_ASKED_BYTES = 64 << 20  # question vectors that one task holds


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of usable vectors of an Arrow column, and the vectors at length 1."""
    good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    flat = (column if len(good) == len(column) else column.take(pa.array(good))).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, width)  # a null component is not a number
    length = np.sqrt((x * x).sum(1))
    fine = np.isfinite(length) & (length > 0)
    return good[fine], x[fine] / length[fine, None]


def _best(asks: pa.Array, matrix: np.ndarray, ids: pa.Array, vectors: pa.Array, top: int, to: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each question, its best of a batch of chunks, ties too: ids decide later."""
    at, x = _unit(vectors, matrix.shape[1])
    if len(at) and len(asks):
        scores = np.round(np.clip(matrix @ x.T, -1, 1), 6)
        k = min(top, len(at))
        q, c = np.nonzero(scores >= np.partition(scores, len(at) - k, axis=1)[:, len(at) - k][:, None])
        yield pa.RecordBatch.from_arrays([asks.take(pa.array(q)), ids.take(pa.array(at[c])), pa.array(scores[q, c])], schema=to)


def check_questions(queries: DataFrame) -> tuple[int, int]:
    """How many questions there are, and their dimension. Questions without a vector, with components that are null or no
    finite numbers, with a zero vector or of unlike dimensions fail."""
    v = F.col("query_vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    many, low, high, wrong, nil = queries.agg(
        F.count("*"), F.min(F.size(v)), F.max(F.size(v)), F.count_if(v.isNull() | (F.size(v) == 0) | F.coalesce(bad, F.lit(True))), F.count_if(~F.exists(v, lambda x: x != 0))
    ).first()
    if wrong:
        raise ValueError(f"{wrong} of {many} questions have no vector of finite numbers")
    if nil:
        raise ValueError(f"{nil} of {many} questions have a zero vector")
    if many and low != high:
        raise ValueError(f"questions have vectors of {low} to {high} components")
    return many, high or 1


def nearest(chunks: DataFrame, queries: DataFrame, top: int = 10, keep: Column | None = None, measure: str = "cosine") -> DataFrame:
    """chunks(chunk_id, embedding), queries(query_id, query_vector): exact neighbours, by "cosine" or by "inner" product
    of unit vectors, which ranks alike.

    The questions are a stated set, checked by `check_questions`. If their vectors fit in `_ASKED_BYTES`, every task has
    them and chunks are read where they are. Otherwise questions are dealt into blocks of that size and chunks into
    slices; a task holds a block and has a slice's chunks streamed past, and nothing of either is on the driver.
    A batch keeps its best for each question, and only these are ranked. A chunk whose vector is null, zero, of another
    dimension or has components that are null or no finite numbers is nobody's neighbour. keep is a condition on
    chunks, for example on their format.
    """
    if keep is not None:
        chunks = chunks.where(keep)
    chunks, queries = chunks.select("chunk_id", F.col("embedding").cast("array<double>").alias("v")), queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    many, width = check_questions(queries)
    small_batches(queries.sparkSession)
    name = "cosine_similarity" if measure == "cosine" else "inner_product"
    shape = StructType([queries.schema["query_id"], chunks.schema["chunk_id"], *StructType.fromDDL(f"{name} double")])
    to = to_arrow_schema(shape)
    blocks = max(1, -(-many * width * 8 // _ASKED_BYTES))
    if blocks == 1:
        asked = queries.toArrow().combine_chunks()
        held = queries.sparkSession.sparkContext.broadcast((asked.column(0).combine_chunks() if many else pa.nulls(0), _unit(asked.column(1).combine_chunks(), width)[1] if many else np.zeros((0, width))))

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _best(*held.value, batch.column(0), batch.column(1), top, to)

        scored = chunks.mapInArrow(past, shape)
    else:
        slices = chunks.sparkSession.sparkContext.defaultParallelism
        place = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asks = queries.select(place(blocks, "query_id").alias("block"), every(slices).alias("slice"), F.lit(0).alias("role"), "query_id", F.col("query_vector").alias("v"))
        rows = chunks.select(every(blocks).alias("block"), place(slices, "chunk_id").alias("slice"), F.lit(1).alias("role"), "chunk_id", "v")

        def held_past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot, ids, vectors, block = None, [], [], None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("block", "slice", "role")], 1)
                edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
                for low, high in zip(edges, [*edges[1:], len(keys)]):
                    part = batch.slice(low, high - low)
                    if tuple(keys[low, :2]) != slot:
                        slot, ids, vectors, block = tuple(keys[low, :2]), [], [], None
                    if keys[low, 2] == 0:
                        ids.append(part.column("query_id"))
                        vectors.append(_unit(part.column("v"), width)[1])
                    elif ids:
                        block = block or (pa.concat_arrays(ids), np.concatenate(vectors))
                        yield from _best(*block, part.column("chunk_id"), part.column("v"), top, to)

        dealt = asks.unionByName(rows, allowMissingColumns=True).repartition("block", "slice").sortWithinPartitions("block", "slice", "role")
        scored = dealt.mapInArrow(held_past, shape)
    scored = scored.withColumn(f"{measure}_distance" if measure == "cosine" else "distance", F.round(1 - F.col(name), 6))
    return ranked(scored, top, F.col(name).desc(), F.col("chunk_id"))


def hyde_texts(questions: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """questions(query_id, question), hypothetical(query_id, hyde_document) to (query_id, question) with both texts, to be
    embedded as one. A question without a hypothetical document fails."""
    both = questions.join(hypothetical.select("query_id", "hyde_document"), "query_id", "left")
    text = F.when(F.col("hyde_document").isNull(), F.raise_error(F.lit("a question has no hypothetical document"))).otherwise(F.concat_ws("\n", "question", "hyde_document"))
    return both.select("query_id", text.alias("question"))


def fuse(vector: DataFrame, lexical: DataFrame, top: int = 10, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked candidate sets: one union and one aggregation, no outer join."""
    null = lambda kind: F.lit(None).cast(kind)
    both = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), null("long").alias("bm25_rank"), "cosine_similarity", null("double").alias("bm25_score")).unionByName(
        lexical.select("query_id", "chunk_id", null("long").alias("vector_rank"), F.col("rank").alias("bm25_rank"), null("double").alias("cosine_similarity"), F.col("score").alias("bm25_score"))
    )
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    merged = both.groupBy("query_id", "chunk_id").agg(*[F.max(c).alias(c) for c in ("vector_rank", "bm25_rank", "cosine_similarity", "bm25_score")])
    merged = merged.withColumn("rrf_score", F.round(part("vector_rank") + part("bm25_rank"), 6))
    first = F.least(F.coalesce("vector_rank", F.lit(10**9)), F.coalesce("bm25_rank", F.lit(10**9)))
    return ranked(merged, top, F.col("rrf_score").desc(), first, F.col("chunk_id"))


def lexical_share(question: Column, content: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's terms that the content has."""
    return _share(X.query_terms(question), X.index_terms(content))


def _share(ask: Column, held: Column) -> Column:
    return X.divide(F.size(F.array_intersect(ask, F.coalesce(held, F.array().cast("array<string>")))), F.size(ask))


def named(results: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results, saved, and the rows of the corpus that they name: where these are few, Spark sees it from the saved table's
    size, and texts that nothing asks for are passed over where they are read, not shuffled."""
    results = kept(results, "results")
    return results, corpus.join(results.select("chunk_id").distinct(), "chunk_id", "left_semi")


def rerank(candidates: DataFrame, questions: DataFrame, corpus: DataFrame, top: int = 5, scorer: Callable[[Column, Column], Column] = lexical_share) -> DataFrame:
    """Candidates in the order of scorer(question, content), which may be a pandas UDF over a model; a score that is no
    finite number fails. For `lexical_share` a question and a content are cut into terms once, not for each candidate."""
    candidates, corpus = named(candidates, corpus)
    asked, texts = questions.select("query_id", "question"), corpus.select("chunk_id", "content")
    if scorer is lexical_share:
        asked, texts, scorer = asked.withColumn("question", X.query_terms("question")), texts.withColumn("content", F.array_distinct(X.index_terms("content"))), _share
    joined = candidates.withColumnRenamed("rank", "hybrid_rank").join(asked, "query_id").join(texts, "chunk_id", "left")
    score = F.coalesce(scorer(F.col("question"), F.col("content")).cast("double"), F.lit(0.0))
    checked = F.when(F.isnan(score) | (F.abs(score) == F.lit(float("inf"))), F.raise_error(F.lit("a reranker's score is not finite"))).otherwise(score)
    scored = joined.withColumn("reranker_score", F.round(checked, 6)).drop("question", "content")
    return ranked(scored, top, F.col("reranker_score").desc(), F.col("hybrid_rank"), F.col("chunk_id"))


def relevance_ranks(results: DataFrame, gold: DataFrame, corpus: DataFrame, least: float = 0.6) -> DataFrame:
    """gold(query_id, expected_source, evidence): (query_id, source_rank, evidence_rank) of the first results that are
    relevant, null if none is.

    A result's source is relevant if its file is the expected one; its evidence, if besides its content holds the
    gold evidence or at least that share of its terms.
    """
    results, corpus = named(results.select("query_id", "rank", "chunk_id"), corpus)
    held = results.join(gold, "query_id").join(corpus.select("chunk_id", "content", "source"), "chunk_id")
    same = X.canonical_filename("source") == X.canonical_filename("expected_source")
    terms = F.array_distinct(X.index_terms(F.col("evidence")))
    share = X.divide(F.size(F.array_intersect(terms, X.index_terms(F.col("content")))), F.size(terms))
    hit = same & (F.contains(X.evaluation_form(F.col("content")), X.evaluation_form(F.col("evidence"))) | (share >= least))
    first = lambda when: F.min(F.when(when, F.col("rank")))
    found = held.groupBy("query_id").agg(first(same).alias("source_rank"), first(hit).alias("evidence_rank"))
    return gold.select("query_id").join(found, "query_id", "left")


def export_candidates(candidates: DataFrame, questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row for each question: its candidates in order with their content, as nested rows ready for JSON lines."""
    full = candidates.join(corpus.select("chunk_id", "content", "source"), "chunk_id", "left")
    cols = [c for c in full.columns if c not in ("query_id", "rank")]
    nested = full.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias("candidates"))
    return questions.join(nested, "query_id", "left").withColumn("candidates", F.coalesce("candidates", F.from_json(F.lit("[]"), nested.schema["candidates"].dataType)))


def evidence_rank(results: DataFrame, gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, rank): the first result whose content holds the gold evidence, null if none does."""
    results, corpus = named(results.select("query_id", "rank", "chunk_id"), corpus)
    held = results.join(gold, "query_id").join(corpus.select("chunk_id", "content"), "chunk_id")
    hit = F.contains(X.evaluation_form(F.col("content")), X.evaluation_form(F.col("evidence")))
    found = held.where(hit).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").join(found, "query_id", "left").select("query_id", "rank")
