"""Metrics of retrieval, latency, classification and of the confidence gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions.text import canonical_filename, divide, evaluation_form, once, recall_at, reciprocal
from lexigrove.operators.percentiles import percentiles, with_percentiles
from lexigrove.sources.shared import kept

#: The grid of gate thresholds; None leaves a rule out.
TOP1 = (0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
MARGIN = (0.00, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30)
COSINE = (None, 0.65, 0.70, 0.75, 0.80, 0.85)
RRF = (None, 0.015, 0.020, 0.025, 0.030)
SUPPORTING = (0, 1, 2, 3)
RULES = ("minimum_top1_score", "minimum_margin", "minimum_cosine_similarity", "minimum_rrf_score", "minimum_supporting_results")


def question_metrics(ranks: DataFrame) -> DataFrame:
    """(query_id, rank) with recall at 1, 3, 5, 10 and the reciprocal rank."""
    r = F.col("rank")
    return ranks.select("*", *[recall_at(r, k).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)], reciprocal(r).alias("reciprocal_rank"))


def means(records: DataFrame, *by: str) -> DataFrame:
    names = [f"recall_at_{k}" for k in (1, 3, 5, 10)]
    return records.groupBy(*by).agg(F.count("*").alias("n_questions"), *[F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in names], F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("mrr"))


def latency(records: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median, interpolated 95th percentile, extremes and total."""
    return latencies(records, (value,), *by).toDF(*by, "n", "mean", "median", "p95", "min", "max", "total")


def latencies(records: DataFrame, values: tuple[str, ...], *by: str) -> DataFrame:
    """(by, then n, mean, median, p95, min, max and total of each value, for example of each step of an answer)."""
    plain = [f for c in values for f in (F.count(c).alias(f"n_{c}"), F.round(F.avg(c), 4).alias(f"mean_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.sum(c), 2).alias(f"total_{c}"))]
    both = with_percentiles(records.groupBy(*by).agg(*plain), percentiles(records, values, {"median": 0.5, "p95": 0.95}, by), by)
    rounded = lambda k, c: F.round(f"{k}_{c}", 4).alias(f"{k}_{c}") if k in ("median", "p95") else F.col(f"{k}_{c}")
    return both.select(*by, *[rounded(k, c) for c in values for k in ("n", "mean", "median", "p95", "min", "max", "total")])


def retrieval_summary(records: DataFrame, *by: str) -> DataFrame:
    """records(query_id, source_rank, evidence_rank, retrieval_time_ms): recall at 1, 3, 5, 10 and reciprocal rank of
    source and evidence, and latency, for each method or format."""
    rates = []
    for what in ("source", "evidence"):
        rank = F.col(f"{what}_rank")
        rates += [F.round(F.coalesce(F.avg(recall_at(rank, k)), F.lit(0.0)), 6).alias(f"{what}_recall_at_{k}") for k in (1, 3, 5, 10)]
        rates.append(F.round(F.coalesce(F.avg(reciprocal(rank)), F.lit(0.0)), 6).alias(f"{what}_mrr"))
    v = "retrieval_time_ms"
    rated = records.groupBy(*by).agg(F.count("*").alias("n_questions"), *rates, F.round(F.avg(v), 4).alias(f"mean_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"))
    both = with_percentiles(rated, percentiles(records, (v,), {"median": 0.5, "p95": 0.95}, by), by)
    times = [F.col(f"mean_{v}"), *[F.round(f"{k}_{v}", 4).alias(f"{k}_{v}") for k in ("median", "p95")], F.col(f"min_{v}"), F.col(f"max_{v}")]
    return both.select(*rated.columns[: len(by) + 1 + len(rates)], *times)


def _placed(summaries: DataFrame, *order: Column) -> DataFrame:
    """summaries, a row for each method, with `place` in an order that ends with the method's name."""
    return summaries.withColumn("place", F.row_number().over(Window.orderBy(*order, F.asc("method"))).cast("long")).orderBy("place")


def compare_methods(summaries: DataFrame) -> DataFrame:
    """Best method first: by evidence reciprocal rank, then recall at 1 and at 5, then time."""
    return _placed(summaries, F.desc("evidence_mrr"), F.desc("evidence_recall_at_1"), F.desc("evidence_recall_at_5"), F.asc("mean_retrieval_time_ms"))


def compare_recalls(summaries: DataFrame) -> DataFrame:
    """Best method first: by recall of evidence at 5, then its reciprocal rank, then time."""
    return _placed(summaries, F.desc("evidence_recall_at_5"), F.desc("evidence_mrr"), F.asc("mean_retrieval_time_ms"))


def confusion(records: DataFrame, expected: Column, predicted: Column, *by: str) -> DataFrame:
    """The confusion matrix and the ratios over it; a ratio over nothing is 0."""
    e, p = expected, predicted
    counted = records.groupBy(*by).agg(F.count_if(e & p).alias("true_positive"), F.count_if(~e & ~p).alias("true_negative"), F.count_if(~e & p).alias("false_positive"), F.count_if(e & ~p).alias("false_negative"))
    return ratios(counted)


def ratios(counted: DataFrame) -> DataFrame:
    """The ratios over rows of the four counts."""
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))
    total = tp + tn + fp + fn
    rates = {
        "accuracy": divide(tp + tn, total), "precision": divide(tp, tp + fp), "recall": divide(tp, tp + fn), "specificity": divide(tn, tn + fp),
        "f1_score": divide(2 * tp, 2 * tp + fp + fn), "false_acceptance_rate": divide(fp, fp + tn), "false_rejection_rate": divide(fn, fn + tp),
        "coverage": divide(tp + fp, total), "rejection_rate": divide(tn + fn, total),
    }
    out = counted.select("*", *[F.round(v, 6).alias(k) for k, v in rates.items()], total.alias("total"), (tp + fp).alias("accepted"), (tn + fn).alias("rejected"))
    return out.withColumn("balanced_error_rate", F.round((F.col("false_acceptance_rate") + F.col("false_rejection_rate")) / 2, 6))


def confidence_features(results: DataFrame) -> DataFrame:
    """results(query_id, rank, reranker_score, cosine_similarity, rrf_score): one row of features for each query."""
    s = F.col("reranker_score")
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = results.groupBy("query_id").agg(
        F.count("*").alias("number_of_results"), at("reranker_score", 1).alias("top1_score"), at("reranker_score", 2).alias("top2_score"), at("cosine_similarity", 1).alias("top1_cosine"),
        at("rrf_score", 1).alias("top1_rrf"), F.round(F.avg(s), 6).alias("mean_score"), F.count_if(s >= 0.5).alias("supporting"),
    )
    return out.withColumn("margin", F.round(F.col("top1_score") - F.coalesce("top2_score", F.lit(0.0)), 6))


def failed_rules(t: dict[str, Column]) -> Column:
    """The gate's rules that a row of features fails, in order. A null threshold leaves its rule out; a null feature counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return F.array_compact(F.array(
        F.when(F.col("top1_score") < t[RULES[0]], "top1_score"), F.when(F.col("margin") < t[RULES[1]], "margin"), F.when(zero("top1_cosine") < t[RULES[2]], "cosine"),
        F.when(zero("top1_rrf") < t[RULES[3]], "rrf"), F.when(F.col("supporting") < t[RULES[4]], "supporting_results"),
    ))


def gate(features: DataFrame, top1: float = 0.3, margin: float = 0.0, cosine: float | None = None, rrf: float | None = 0.015, supporting: int = 0) -> DataFrame:
    limits = {r: F.lit(v).cast("double") for r, v in zip(RULES, (top1, margin, cosine, rrf, supporting))}
    return features.select("query_id", failed_rules(limits).alias("failed")).select("query_id", (F.size("failed") == 0).alias("accepted"), F.array_join("failed", ",").alias("failed_rules"))


GRID = dict(zip(RULES, (TOP1, MARGIN, COSINE, RRF, SUPPORTING)))


def grid(spark: SparkSession, values: dict[str, tuple] = GRID) -> DataFrame:
    """All combinations of thresholds, with each one's place among its rule's: exploded arrays of fixed size."""
    out = spark.range(1)
    for i, rule in enumerate(RULES):
        out = out.select("*", F.posexplode(F.array(*[F.lit(v).cast("double") for v in _rising(values[rule])])).alias(f"i{i}", rule))
    return out.drop("id")


def _rising(values: tuple) -> list:
    """A rule's thresholds from the one that lets most pass: None lets all."""
    return sorted(values, key=lambda v: (v is not None, v))


def search_thresholds(features: DataFrame, values: dict[str, tuple] = GRID) -> DataFrame:
    """features also has `expected`. One row of metrics for each combination of thresholds.

    A row of features falls into a cell: for each rule, how many of its thresholds it passes. A combination accepts
    the cells that pass its threshold of every rule, so their counts, summed from above along one rule after the
    other, are what it accepts. There are at most as many cells as combinations, and rows are only counted into them.
    """
    told = {RULES[0]: F.col("top1_score"), RULES[1]: F.col("margin"), RULES[2]: F.coalesce("top1_cosine", F.lit(0.0)), RULES[3]: F.coalesce("top1_rrf", F.lit(0.0)), RULES[4]: F.col("supporting").cast("double")}
    passed = lambda rule: F.size(F.filter(F.array(*[F.lit(v).cast("double") for v in _rising(values[rule])]), lambda t: F.coalesce(told[rule] >= t, F.lit(True))))
    cells = features.groupBy(*[(passed(rule) - 1).alias(f"i{i}") for i, rule in enumerate(RULES)]).agg(F.count_if("expected").alias("e"), F.count_if(~F.col("expected")).alias("o"))
    cells = kept(cells, "cells")
    places = [f"i{i}" for i in range(len(RULES))]
    all_ = cells.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("all_e"), F.coalesce(F.sum("o"), F.lit(0)).alias("all_o"))
    summed = grid(features.sparkSession, values).join(cells, places, "left").fillna(0, ["e", "o"])
    for place in places:
        above = Window.partitionBy(*[p for p in places if p != place]).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)
        summed = summed.withColumns({"e": F.sum("e").over(above), "o": F.sum("o").over(above)})
    counts = summed.join(F.broadcast(all_)).select(*RULES, F.col("e").alias("true_positive"), (F.col("all_o") - F.col("o")).alias("true_negative"), F.col("o").alias("false_positive"), (F.col("all_e") - F.col("e")).alias("false_negative"))  # all_: one row
    return ratios(counts)


def judge_thresholds(best: DataFrame, features: DataFrame) -> DataFrame:
    """The metrics of the first combination of best on features of another set of questions."""
    first = F.broadcast(best.select(*RULES).limit(1))
    accepted = F.size(failed_rules({r: F.col(r) for r in RULES})) == 0
    return confusion(features.join(first).withColumn("accepted_", accepted), F.col("expected"), F.col("accepted_"), *RULES)


def best_thresholds(results: DataFrame, top: int = 20) -> DataFrame:
    down = lambda c: F.col(c).desc()
    return results.orderBy("false_acceptance_rate", down("f1_score"), down("accuracy"), "balanced_error_rate", down("recall"), down("coverage"), *[F.col(r).asc_nulls_first() for r in RULES]).limit(top)


def compared(summaries: dict[str, DataFrame]) -> DataFrame:
    """One table of the methods' summaries, the best first: by mrr, then recall at 1 and at 5, then name."""
    every = reduce(DataFrame.unionByName, [s.withColumn("method", F.lit(name)) for name, s in summaries.items()])
    return every.orderBy(F.desc("mrr"), F.desc("recall_at_1"), F.desc("recall_at_5"), "method")


_RUN = 3  # words of a run that evidence is looked up by
_PIECE = 4  # characters of a piece, for evidence without such a run


def _runs(parts: Column, n: int) -> Column:
    """All runs of n neighbours of an array of texts; none where there are fewer."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))
    return once(parts, lambda w: F.when(F.size(w) >= n, of(w)).otherwise(F.array().cast("array<array<string>>")))


def _word_keys(form: Column, inner: bool) -> Column:
    """Runs of words. Evidence may begin and end inside a word of a page, so its first and last words are in none."""
    words = F.split(form, " ")
    used = once(words, lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))) if inner else words
    return F.transform(_runs(used, _RUN), lambda r: F.array_join(r, " "))


def _piece_keys(form: Column) -> Column:
    """Pieces of characters, marked so that they are no words, and single characters."""
    return once(F.split(form, ""), lambda c: F.concat(F.transform(_runs(c, _PIECE), lambda r: F.concat(F.lit("\x00"), F.array_join(r, ""))), F.transform(c, lambda x: F.concat(F.lit("\x01"), x))))


def _asked_keys(form: Column) -> Column:
    """What evidence is looked up by: runs of words, or, for evidence of few words, pieces, or its first character."""
    return F.when(F.size(F.split(form, " ")) >= _RUN + 2, _word_keys(form, True)).when(F.length(form) >= _PIECE, F.filter(_piece_keys(form), lambda k: k.startswith("\x00"))).otherwise(F.array(F.concat(F.lit("\x01"), F.substring(form, 1, 1))))


def _holders(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """wanted(file, form), held(file, page, n) to (file, form, n): the pages of a file that hold a form.

    A form is looked up by the run of words that the fewest of the file's pages have, and only these pages are searched
    for the whole of it: no pairs of a file are made, whatever share of all pages it has. Forms of fewer than five words
    are looked up by pieces of characters in the same way. held is read several times and should be a saved table.
    """
    keyed = wanted.where("form <> ''").select("file", "form").distinct().select("file", "form", F.explode(F.array_distinct(_asked_keys(F.col("form")))).alias("key"))
    keyed = kept(keyed.select("file", "form", F.xxhash64("file", "key").alias("h"), F.substring("key", 1, 1).isin("\x00", "\x01").alias("short")), "evidence-keys")
    few = keyed.where("short").select("file").distinct()
    runs = held.select("n", "file", F.explode(F.array_distinct(_word_keys(F.col("page"), False))).alias("key"))
    runs = runs.unionByName(held.join(few, "file", "left_semi").select("n", "file", F.explode(F.array_distinct(_piece_keys(F.col("page")))).alias("key")))
    # a key's pages: those of keys that some evidence has
    met = kept(runs.select("n", F.xxhash64("file", "key").alias("h")).join(keyed.select("h").distinct(), "h", "left_semi"), "evidence-met")
    counts = met.groupBy("h").agg(F.count("*").alias("pages"))
    rarest = keyed.join(counts, "h", "left").groupBy("file", "form").agg(F.min(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "h")).alias("r")).where("r.pages > 0").select("file", "form", F.col("r.h").alias("h"))
    return rarest.join(met, "h").join(held.select("n", "page"), "n").where(F.col("page").contains(F.col("form"))).select("file", "form", "n").distinct()


def evidence_present(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items(id, source, evidence) with present: whether any page(source, content) of the item's source holds it. Both are
    compared in their evaluation form, sources by their file name; a blank evidence is nowhere."""
    asked = kept(items.select("id", canonical_filename("source").alias("file"), evaluation_form("evidence").alias("form")), "evidence")
    held = kept(pages.select(canonical_filename("source").alias("file"), evaluation_form("content").alias("page"), F.monotonically_increasing_id().alias("n")), "evidence-pages")
    found = _holders(asked, held).select("file", "form").distinct()
    hits = asked.join(found.withColumn("hit", F.lit(True)), ["file", "form"], "left").groupBy("id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("present"))
    return items.select("id").join(hits, "id")


def evidence_homes(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items(id, evidence), pages(page_id, content) to (id, page_id): the smallest id of a page that holds the evidence; items
    that no page holds are left out."""
    asked = kept(items.select("id", F.lit("").alias("file"), evaluation_form("evidence").alias("form")), "evidence")
    held = kept(pages.select(F.lit("").alias("file"), evaluation_form("content").alias("page"), F.col("page_id").alias("n")), "evidence-pages")
    first = _holders(asked, held).groupBy("form").agg(F.min("n").alias("page_id"))
    return asked.join(first, "form").select("id", "page_id")


def with_times(statistics: DataFrame, times: DataFrame, *keys: str) -> DataFrame:
    """Statistics of chunkings with the times they took, null where none was taken; times has one row for each key."""
    return statistics.join(times, list(keys), "left")
