"""Quality by robust outliers against numpy, and the defined cases."""

import re
import time
from collections import Counter

import numpy as np
import pytest

from lexigrove.llm import common, quality
from tests.conftest import DATA
from tests.llm.brute import WORD

SCHEMA = "doc_id long, text string, lang string, source string, id long, g string, n int, z0 string, rows int, n_words string, half int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "g", 2, "z", 3, "w", 4) for r in rows], SCHEMA)


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines)


def judged(rows, least_words=50, most_repeats=50, prior=50.0, steps=6):
    """rows (id, text, lang, source) -> {row number: (the five counts, base_failed, distance or None)}."""
    p, stats = 5, [base(r[1]) for r in rows]
    failed = [s[0] < least_words or 100 * s[4] > most_repeats * s[0] for s in stats]
    unit = np.array([0.5, 0.05, 0.3, 0.2, 0.2]) / 16
    z = {}
    for k, s in enumerate(stats):
        if not failed[k]:
            v = [np.log(s[0]), np.log(s[1] / s[0]), np.log1p(100 * s[2] / s[1]), np.sqrt(s[3] / s[5]), np.sqrt(s[4] / s[0])]
            z[k] = np.floor(np.array(v) / unit + 0.5)
    groups = {None: list(z)}
    for k in z:
        groups.setdefault((rows[k][2], rows[k][3]), []).append(k)
    floor = np.eye(p) * 256

    def far(x, m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def moments(x, factor):
        return x.mean(0), factor * np.cov(x.T, bias=True).reshape(p, p) + floor

    def lower(x):
        return np.sort(x, axis=0)[(len(x) - 1) // 2]

    def drawn(found, n):
        m0, c0 = found[None]
        return {g: ((n[g] * m + prior * m0) / (n[g] + prior), (n[g] * c + prior * c0) / (n[g] + prior)) for g, (m, c) in found.items()}

    raw, half = {}, {}
    for g, members in groups.items():
        x = np.array([z[k] for k in members]).reshape(-1, p)
        if not len(x):
            return {k: (stats[k][:5], failed[k], None) for k in range(len(rows))}
        half[g] = (len(x) + p + 1) // 2
        middle = lower(x)
        ends = []
        for m, c in ((x.mean(0), np.cov(x.T, bias=True).reshape(p, p) + floor), (middle, np.diag((1.4826 * lower(np.abs(x - middle))) ** 2) + floor)):
            for _ in range(steps):
                bins = np.minimum(4095, np.floor(256 * np.sqrt(far(x, m, c))))
                near = x[bins <= np.sort(bins)[min(half[g], len(x)) - 1]]
                m, c = moments(near, quality.consistency(0.5))
            ends.append((np.linalg.slogdet(c)[1], m, c))
        raw[g] = min(ends, key=lambda e: e[0])[1:]
    raw, usual, n = drawn(raw, half), {}, {}
    for g, members in groups.items():
        x = np.array([z[k] for k in members])
        near = x[far(x, *raw[g]) <= quality.chi2_quantile(0.975, p)]
        usual[g], n[g] = (moments(near, quality.consistency(0.975)), len(near)) if len(near) else (raw[g], 0)
    last = drawn(usual, n)
    return {k: (s[:5], failed[k], None if failed[k] else float(np.sqrt(far(z[k][None], *last[rows[k][2:4]])[0]))) for k, s in enumerate(stats)}


def agree(got, rows):
    want = judged(rows)
    most = np.sqrt(quality.chi2_quantile(1 - 1e-6, 5))
    shape = lambda doc, s, bad, d: (repr(doc), tuple(s), bad, None if d is None else round(d, 6), d is not None and d <= most)
    out = [shape(r["id"], [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r["base_failed"], r["distance"]) for r in got.collect()]
    assert sorted(out, key=repr) == sorted((shape(rows[k][0], *v) for k, v in want.items()), key=repr)
    assert sorted((repr(r["id"]), r["kept"]) for r in got.collect()) == sorted((x[0], x[4]) for x in out)


def prose(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8))) for _ in range(n))


def test_whole_table_and_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    agree(quality.screen_quality(docs), rows)
    good = dict(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").collect())
    kept = {r["doc_id"]: r["kept"] for r in quality.op12_quality(spark, DATA).where("not base_failed").collect()}
    assert all(kept[d] == bool(q) for d, q in good.items() if d in kept)


def test_plan_is_native(spark):
    plan = quality.screen_quality(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_junk_in_a_hot_group_and_lone_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, int(rng.integers(60, 160))), "en", "hot" if i % 3 else f"s{i}") for i in range(150)]
    junk = [(1000 + i, " ".join(f"{w}#$%&" for w in prose(rng, 90).split()), "en", "hot" if i % 2 else f"t{i}") for i in range(8)]
    long_words = [(2000, " ".join("x" * 60 + str(i) for i in range(80)), "en", "hot")]
    agree(quality.screen_quality(frame(spark, rows + junk + long_words)), rows + junk + long_words)
    kept = {r["id"] for r in quality.screen_quality(frame(spark, rows + junk + long_words)).where("kept").collect()}
    assert kept == {r[0] for r in rows}


def joins_by_table(monkeypatch):
    """Filled by name with the joins in the plan of each scratch table, as it is saved."""
    joins, save = {}, common.Scratch.save

    def counted(self, df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return save(self, df, name)

    monkeypatch.setattr(common.Scratch, "save", counted)
    return joins


def test_a_step_joins_once(spark, monkeypatch):
    joins = joins_by_table(monkeypatch)
    quality.screen_quality(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert [joins[f"step-{k}"] for k in range(1, 7)] == [1] * 6


def test_hot_groups_beside_others(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, int(rng.integers(60, 160))), "en", "hot" if i % 3 else f"s{i % 12}") for i in range(150)]
    joins = joins_by_table(monkeypatch)
    monkeypatch.setattr(common, "_HOT", 10)
    agree(quality.screen_quality(frame(spark, rows)), rows)
    assert {"cells-hot", "cells-others"} < set(joins) and [joins[f"step-{k}"] for k in range(1, 7)] == [2] * 6


def test_defined_cases(spark):
    rng = np.random.default_rng(7)
    same = prose(rng, 70)
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n ", None, None), (None, same, None, None), (4, same, "en", None), (4, same, "en", None), (5, same, "", "s"), (6, same, None, "s"),
        (7, "a b c " * 40, "en", "s"), (8, "a b c\r\n" * 3 + "a b\n\n\x0b\n" + same, "en", "s"), (9, "ü \U0001f600 # " + same, "en", "s"), (10, "one two", "en", "s"), (11, "a a a a", "en", "s"),
    ]
    got = quality.screen_quality(frame(spark, rows), carry=("id", "g", "text"))
    assert got.columns[-3:] == ["c0", "c1", "c2"]
    agree(got, rows)
    assert quality.screen_quality(frame(spark, rows).where("doc_id < 0")).count() == 0
    agree(quality.screen_quality(frame(spark, rows[:3])), rows[:3])


@pytest.mark.parametrize("text", ["x" * (1 << 20), " ".join(f"w{i % 7919}x{i % 13}" for i in range(200_000)), "a\n" * (1 << 19), "b " * (1 << 19)])
def test_long_texts_take_time_in_proportion(spark, text):
    quality.base_statistics(frame(spark, [(0, text[:1000], "en", "s")])).count()
    began = time.time()
    row = quality.base_statistics(frame(spark, [(1, text, "en", "s")]).select("doc_id", "text")).first()
    assert time.time() - began < 20
    assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")) == base(text)


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.5, 4) - 3.356694) < 1e-6 and abs(quality.chi2_quantile(0.975, 5) - 12.832502) < 1e-6
    assert abs(quality.consistency(1 - 1e-12) - 1) < 1e-6
