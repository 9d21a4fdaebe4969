"""Documents to training tokens: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet
before the next one reads it. All but the last return the columns of documents.

Defined cases, for run() and for every stage: further columns of documents are carried unchanged, whatever their
names; null and empty texts are clean, have no lines to drop, are no near copies and are taken by the mix, adding
nothing; very long texts are one row each, and encoded in shared-out stretches; rows without an id stay, each for
itself; a repeated row is judged like the first, and both stay where the first does; ties go to the smallest id
(near copies) or the largest one (lines); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from lexigrove.llm.common import Scratch


def _coded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that no operator has, and which is which."""
    codes = [f"column_{i}_of_docs" for i in range(len(docs.columns))]
    return docs.toDF(*codes), dict(zip(docs.columns, codes))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated score of 0.5 or more go."""
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    coded, of = _coded(docs)
    scored = toxicity.score_toxicity(coded, model, of["doc_id"], of["text"], carry=tuple(c for n, c in of.items() if n != "doc_id"))
    return scored.where("predicted = 0").select(*of.values()).toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    coded, of = _coded(docs)
    kept = line_dedup.dedup_lines(coded, of["doc_id"], of["text"], carry=tuple(c for n, c in of.items() if n not in ("doc_id", "text", "n_chars")))
    if "n_chars" in of:
        kept = kept.withColumn(of["n_chars"], F.length(of["text"]).cast(docs.schema["n_chars"].dataType))
    return kept.select(*of.values()).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, five words a shingle and a similarity of 0.8 or more."""
    kept = near_dedup.NearDedup(percent=80, bands=43, rows=5)(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    coded, of = _coded(docs)
    left = coded.join(kept, F.col(of["doc_id"]) == F.col("doc_id"), "left_semi").unionByName(coded.where(F.col(of["doc_id"]).isNull()))
    return left.toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of token digests for each document and repetition."""
    return bpe.digests(bpe.encode_texts(docs.select("doc_id", "text"), bpe.vocabulary()))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("MinHash near-dedup", drop_copies), ("mixing", mix), ("byte-level BPE", encode)]

#: No SQL: a trained model decides the first stage. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token digests of the mix: one row for each document and repetition. A stage's scratch tables go once it is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        since = len(Scratch.made())
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        Scratch.release(since)
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
