"""Metadata of any shape: strings at any depth, and nothing else, are cleaned."""

import json

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import metadata
from lexigrove.operators.sections import fold

TOLD = {
    "title": "  Azure   “Reliability”​ ", "tags": ["a  b", "", ["deep\t list", {"k  k": "x\n y"}], None, True], "n": 12345678901234567890, "x": 1.50, "big": 1e300, "nested": {"a": {"b": {"c": ' "q" \\ é '}}},
    "empty": {}, "none": None, "list": [],
}


def cleaned(value, fn):
    if isinstance(value, str):
        return fn(value)
    if isinstance(value, list):
        return [cleaned(v, fn) for v in value]
    return {k: cleaned(v, fn) for k, v in value.items()} if isinstance(value, dict) else value


@pytest.mark.parametrize("fn", [metadata.single_spaced, lambda t: fold(t).strip()])
def test_strings_at_any_depth(spark, fn):
    df = spark.createDataFrame([(1, json.dumps(TOLD)), (2, '"  just a text "'), (3, "[1, 2.0, false]"), (4, None)], "id long, j string").withColumn("v", F.parse_json("j"))
    got = {r["id"]: r["j"] for r in df.select("id", F.to_json(metadata.each_string(fn)(F.col("v"))).alias("j")).collect()}
    assert json.loads(got[1]) == cleaned(TOLD, fn)
    assert (json.loads(got[2]), json.loads(got[3]), got[4]) == (fn("  just a text "), [1, 2, False], None)


def test_keys_and_paths(spark):
    df = spark.createDataFrame([(json.dumps(TOLD),)], "j string").withColumn("v", F.parse_json("j"))
    row = df.select(
        F.to_json(metadata.each_string(metadata.single_spaced, keys=True)(F.col("v"))).alias("j"), metadata.filled(F.col("v"), "$.nested.a.b.c").alias("c"), metadata.filled(F.col("v"), "$.gone").alias("gone"),
        metadata.filled(F.col("v"), "$.tags[1]").alias("blank"), metadata.filled(F.col("v"), "$.x", "double").alias("x"),
    ).first()
    assert json.loads(row["j"])["tags"][2][1] == {"k k": "x y"}
    assert (row["c"], row["gone"], row["blank"], row["x"]) == (' "q" \\ é ', None, None, 1.5)
