"""Exact interpolated percentiles of groups of any size, by selection with pivots.

A mergeable sketch gives each group pivots; counts of all values, which are exact, then say whether the
wanted rank is one of two pivots or between them. Only values strictly between are looked at in the next round, so that
each round leaves some out, until they are so few that they can be sorted. No values are shuffled before that, and a round shuffles one row for each group and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.sources.shared import scratch

_SORTED = 5_000  # values of a bracket that are sorted
_PIVOTS = 500


def _pivots(v: Column) -> Column:
    return F.percentile_approx(v, [k / _PIVOTS for k in range(_PIVOTS + 1)], 10_000)


def percentiles(rows: DataFrame, values: tuple[str, ...], probabilities: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, then name_value for each name of probabilities and value): the interpolated value at place (n - 1) * p.

    Nulls are left out, as numbers that are none stand last; a group without values has null. A null in by is a group
    of its own. The driver learns one number a round.
    """
    spark = rows.sparkSession
    work = scratch(spark, "percentiles")

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    group = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(None).cast("int").alias("none"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in values]))
    tall = saved(rows.select(group.alias("g"), each.alias("e")).select("g", "e.name", "e.v"), "values")
    there = tall.where("v is not null")
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("p"), F.lit(float(p)).alias("at")) for n, p in probabilities.items()]))

    def bracket(states: DataFrame, place: Column, among: Column) -> DataFrame:
        """Pivots on both sides of a place among so many values: a pivot is a value, and the next counts make sure of it."""
        at = F.when(among > 1, place / (among - 1)).otherwise(0.0) * _PIVOTS
        pick = lambda c: F.element_at("pivots", F.greatest(F.lit(0), F.least(F.lit(_PIVOTS), c)).cast("int") + 1)
        return states.withColumns({"low": pick(F.floor(at) - 1), "high": pick(F.ceil(at) + 1)}).select("g", "name", "p", "want", "rank", "low", "high")

    first = there.groupBy("g", "name").agg(F.count("*").alias("n"), _pivots(F.col("v")).alias("pivots"))
    first = first.select("g", "name", "n", "pivots", asked.alias("a")).select("g", "name", "n", "pivots", "a.p", ((F.col("n") - 1) * F.col("a.at")).alias("want")).withColumn("rank", F.floor("want"))
    states, settled, k = saved(bracket(first, F.col("rank"), F.col("n")), "round-0"), [], 0
    v, low, high, rank = F.col("v"), F.col("low"), F.col("high"), F.col("rank")
    inside = F.when((low.isNull() | (v > low)) & (high.isNull() | (v < high)), v)
    while True:
        counted = there.join(states, ["g", "name"]).groupBy("g", "name", "p", "want", "rank", "low", "high").agg(
            F.count_if(v < low).alias("below"), F.count_if(v == low).alias("lows"), F.count(inside).alias("inside"), F.count_if(v == high).alias("highs"), _pivots(inside).alias("pivots")
        )  # a bracket without a low or high end has no such values
        left = rank - F.col("below") - F.col("lows")  # the rank among the values inside
        side = F.when(rank < F.col("below"), "before").when(left < 0, "low").when(left < F.col("inside"), F.when(F.col("inside") <= _SORTED, "few").otherwise("many"))
        side = side.when(left < F.col("inside") + F.col("highs"), "high").otherwise("after")
        counted = saved(counted.withColumns({"left": left, "side": side}), f"counts-{k}")
        settled.append(counted.where("side in ('low', 'high', 'few')").drop("pivots"))
        open_ = counted.where("side not in ('low', 'high', 'few')")
        if open_.isEmpty():
            break
        k += 1
        none = F.lit(None).cast("double")
        missed = open_.where("side <> 'many'").select("g", "name", "p", "want", "rank", F.when(F.col("side") == "after", high).otherwise(none).alias("low"), F.when(F.col("side") == "before", low).otherwise(none).alias("high"))
        states = saved(bracket(open_.where("side = 'many'"), F.col("left"), F.col("inside")).unionByName(missed), f"round-{k}")
    ends = reduce(DataFrame.unionByName, settled)
    few = there.join(ends.where("side = 'few'"), ["g", "name"]).where(inside.isNotNull())
    few = few.groupBy("g", "name", "p", "want", "rank", "left").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most _SORTED values
    few = few.select("g", "name", "p", "want", "rank", F.element_at("vs", (F.col("left") + 1).cast("int")).alias("x"))
    found = saved(few.unionByName(ends.where("side <> 'few'").select("g", "name", "p", "want", "rank", F.when(F.col("side") == "low", low).otherwise(high).alias("x"))), "found")
    # the next place has the same value as long as there are more of it, else the least greater one
    upto = there.join(found, ["g", "name"]).groupBy("g", "name", "p", "want", "rank", "x").agg(F.count_if(F.col("v") <= F.col("x")).alias("upto"), F.min(F.when(F.col("v") > F.col("x"), F.col("v"))).alias("next"))
    share = F.col("want") - F.col("rank")
    after = F.when(F.col("upto") > F.col("rank") + 1, F.col("x")).otherwise(F.coalesce("next", "x"))
    out = upto.select("g", "name", "p", F.when(share == 0, F.col("x")).otherwise((1 - share) * F.col("x") + share * after).alias("x"))
    one = lambda p, c: F.max(F.when((F.col("name") == c) & (F.col("p") == p), F.col("x"))).alias(f"{p}_{c}")
    wide = tall.select("g").distinct().join(out, "g", "left").groupBy("g").agg(*[one(p, c) for c in values for p in probabilities])
    return wide.select(*[F.col("g")[f"k{i}"].alias(c) for i, c in enumerate(by)], *[f"{p}_{c}" for c in values for p in probabilities])


def with_percentiles(summary: DataFrame, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """summary and percentiles of the same groups side by side; without groups, both have one row at most."""
    if not by:
        return summary.join(F.broadcast(found), how="left")
    right = found.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in found.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return summary.join(right, on, "left").drop(*[f"_{c}" for c in by])
