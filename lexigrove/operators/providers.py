"""Answers from providers in turn: retries, fallback, and a log of attempts with each answer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.percentiles import percentiles, with_percentiles

Provider = Callable[[str], str]
ANSWER = "answer string, provider string, attempts array<struct<provider:string,attempt:int,ok:boolean,error:string>>"


def generate(prompts: DataFrame, providers: list[tuple[str, Provider]], validate: Callable[[str, dict], str | None] | None = None, retries: int = 2, delay: float = 0.0) -> DataFrame:
    """prompts(query_id, prompt, ...) to (query_id, answer, provider, attempts), in the partitions that prompts has.

    A provider that raises is asked again, up to `retries` times after the first. An answer that `validate`, given the
    row, has something against (it returns the reason) ends that provider's turn. Where no provider is left, answer and
    provider are null: one question's failure is not another's.
    """
    kind = prompts.schema["query_id"].dataType.simpleString()

    def ask(row: dict) -> tuple:
        log = []
        for name, provider in providers:
            for attempt in range(1, retries + 2):
                try:
                    answer = provider(row["prompt"])
                except Exception as e:  # whatever a provider's client raises is a failed attempt
                    log.append({"provider": name, "attempt": attempt, "ok": False, "error": f"{type(e).__name__}: {e}"})
                    if attempt <= retries and delay:
                        time.sleep(delay)
                    continue
                reason = validate(answer, row) if validate else None
                log.append({"provider": name, "attempt": attempt, "ok": reason is None, "error": reason})
                if reason is None:
                    return row["query_id"], answer, name, log
                break
        return row["query_id"], None, None, log

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([ask(r) for r in pdf.to_dict("records")], columns=["query_id", "answer", "provider", "attempts"])

    return prompts.mapInPandas(run, f"query_id {kind}, {ANSWER}")


def suite_summary(results: DataFrame) -> DataFrame:
    """results(expected, predicted, llm_called, input_tokens, output_tokens, citations_valid, total_ms): one row of counts,
    accuracy, token sums, citation validity among answers that were asked for, and mean and median time."""
    e, p, called = F.col("expected"), F.col("predicted"), F.col("llm_called")
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    counted = results.agg(
        F.count("*").alias("questions"), F.count_if(e & p).alias("true_positive"), F.count_if(~e & ~p).alias("true_negative"), F.count_if(~e & p).alias("false_positive"), F.count_if(e & ~p).alias("false_negative"),
        share(F.count_if(e == p), F.count("*")).alias("accuracy"), F.count_if(called).alias("llm_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), share(F.count_if(called & F.col("citations_valid")), F.count_if(called)).alias("citation_validity"),
        F.round(F.avg("total_ms"), 4).alias("mean_total_ms"),
    )
    return with_percentiles(counted, percentiles(results, ("total_ms",), {"median": 0.5}), ())


def suite_errors(results: DataFrame) -> DataFrame:
    """Rows that went wrong, each with its kinds: wrong_prediction, invalid_citations, failed_llm."""
    kinds = F.array_compact(F.array(
        F.when(F.col("expected") != F.col("predicted"), "wrong_prediction"), F.when(F.col("llm_called") & ~F.col("citations_valid"), "invalid_citations"),
        F.when(F.col("llm_called") & F.coalesce(F.col("llm_failed"), F.lit(False)), "failed_llm"),
    ))
    return results.withColumn("errors", kinds).where(F.size("errors") > 0)
