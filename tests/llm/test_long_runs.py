"""A megabyte without white space: time in proportion, in Python functions that see whole texts, and equal results."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import pii, toxicity
from tests.conftest import DATA
from tests.llm import brute

_OLD_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[@$!|*0134578]++[^\W\d_]++)+|[@$0134578]+[^\W\d_]{2,}")  # without a rule on where a run starts
RUNS = ["0", "@", "a", "a1", "A", "é", "!", ".", "1.", "0.0.0.", "+", "+1", "a_", "a ", "ff:", "a@", "a@b.", "(", "4 ", "İ"]


@pytest.mark.parametrize("lead", ["", "a1b "])
@pytest.mark.parametrize("run", RUNS)
def test_a_megabyte(run, lead):
    text = lead + run * ((1 << 20) // len(run))
    toxicity.capitals(), toxicity.marks()
    began = time.time()
    assert np.isfinite(toxicity.Features({"bad": 2})(text)).all()
    pii.base_spans(text)
    found = list(pii.proposals(text))
    [pii.measure(k, text, lo, hi) for k, lo, hi in found[:1000]]
    assert time.time() - began < 10


def test_masked_words_are_the_same(spark):
    rng = random.Random(4)
    texts = [r["text"].lower() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r["text"]]
    texts += ["".join(rng.choice("ab1@!| _.é0") for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    assert all(toxicity._MASKED.findall(t) == _OLD_MASKED.findall(t) for t in texts)


def test_base_spans_of_digits_and_points():
    rng = random.Random(5)
    for _ in range(30_000):
        text = "".join(rng.choice("0129....25 +-") for _ in range(rng.randint(0, 40)))
        assert [f"{k}:{lo}:{hi}" for k, spans in pii.base_spans(text).items() for lo, hi in spans] == brute.personal(text)


def test_capitals_of_any_script():
    share = lambda t: toxicity.Features({})(t)[toxicity.FEATURES.index("capital_letters")]
    assert share("ABCDE f") == pytest.approx(5 / 7) and share("ABCDEİ") == 1.0 and share("ΑΣ") == 1.0 and share("abc") == 0.0


def test_calibration_is_apart(spark):
    """Turning a fold's labels changes neither the lexicon nor the trees that calibrate it."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    args = ("doc_id", "text", "toxic", 12_000, 400)
    plain = toxicity.fit(docs, labels, *args)[1]
    for k in range(2):
        turned = labels.withColumn("toxic", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        (lexicon, trees), (other, others) = plain[k], toxicity.fit(docs, turned, *args)[1][k]
        assert lexicon == other and trees.start == others.start
        assert all(np.array_equal(a, b) for name in ("feature", "cut", "value") for a, b in zip(getattr(trees, name), getattr(others, name)))
