"""Operators on documents against plain Python, and their defined cases."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexigrove.llm import bpe, common, line_dedup, mixing, near_dedup, pii, sharding, substring_dedup, toxicity
from tests.conftest import DATA
from tests.llm import brute

LINE = "This very line is shared by a good many documents of the table"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, rank int, node long, shard int, copies int, kept string, component_id string, score string, h long, base string, ids string"
LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) under documents' columns and others that clash with the operators' own."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "x", 2, 3, 4, 5, "n", "c", "s", 6, "b", "i") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a b c d e f g", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (None, "a b c d e f g", "en", None), (4, LONG, "en", "s2"),
        (5, f"x\n  {LINE}\t\ny", "en", "s1"), (5, f"x\n  {LINE}\t\ny", "en", "s1"), (6, LINE.upper(), "de", "s2"), (7, LINE, "de", "s3"), (8, f"{LINE}\n{LINE}", "de", "s3"),
        (9, " \t\n ", "fr", "s2"), (10, "one two", "fr", "s2"), (11, "one  TWO", "fr", "s2"), (12, "ünï côdé 日本語 \U0001f600　x", "ja", "s1"), (13, LONG + " tail", None, "s2"),
    ]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def small(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("hot", [10_000, 50, 1])  # all, some and no lines in the index that every task has
def test_lines(spark, odd, small, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "_HOT", hot)
    for rows, df in ((pairs(odd), odd), ([x[:2] for x in small], spark.read.parquet(f"{DATA}/documents.parquet"))):
        got = [tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()]
        order = lambda r: (r[0] is None, r[0] or 0, r[3])
        assert sorted(got, key=order) == sorted(brute.lines(rows), key=order)
    carried = line_dedup.dedup_lines(odd, carry=("id", "size", "text"))
    assert carried.columns == ["doc_id", "text", "n_lines", "n_dropped", "id", "size"]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    made = line_dedup.PerfectHash.build(keys)
    assert sorted(made.slots(keys)) == list(range(len(keys)))


@pytest.mark.parametrize(("sample", "few"), [(64, 8), (1, 0), (1, 2)])  # no, all and some anchors are hot
def test_substrings(spark, small, monkeypatch, sample, few):
    monkeypatch.setattr(substring_dedup, "_SAMPLE", sample)
    monkeypatch.setattr(substring_dedup, "_FEW", few)
    got = [tuple(r) for r in substring_dedup.dedup_substrings(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got) == sorted(brute.substrings([x[:2] for x in small]))


@pytest.mark.parametrize("few", [10_000, 3])
def test_substrings_across_shards_and_crowds(spark, monkeypatch, few):
    monkeypatch.setattr(substring_dedup, "_CROWD", 3)
    monkeypatch.setattr(substring_dedup, "_SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "_FEW", few)
    monkeypatch.setattr(substring_dedup, "_SHARD_WORDS", 200)
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [f"r{x}" for x in rng.integers(0, 30, rng.integers(0, 50))]
        lo = int(rng.integers(0, 30))
        rows.append((i, " ".join(words + passage[lo : lo + int(rng.integers(0, 40))] + words[:25])))
    df = spark.createDataFrame([(a, b, None, None) for a, b in rows], "doc_id long, text string, lang string, source string")
    got = [tuple(r) for r in substring_dedup.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got) == brute.substrings(rows)


def test_matching_statistics():
    text = np.array([0, 1, 2, 1, 2, 3, 0, 1, 2, 0], np.int32)
    index = substring_dedup.FmIndex(text, 4)
    length, lo, hi = index.matching_statistics(text, np.array([3, 6, 5, 9]), 4)
    assert length.tolist() == [2, 0, 2, 2]
    assert sorted(index.order[lo[0] : hi[0]].tolist()) == [1, 3, 7]
    rng = np.random.default_rng(9)
    words = rng.integers(1, 4, 400)
    words[rng.integers(0, 400, 20)] = 0
    text = np.r_[0, words, 0].astype(np.int32)
    length, lo, hi = substring_dedup.FmIndex(text, 12).matching_statistics(text, np.arange(1, len(text)), 12)
    plain = text.tolist()
    for end, n in enumerate(length.tolist(), 1):
        often = lambda k: sum(plain[i : i + k] == plain[end - k : end] for i in range(len(plain) - k + 1))
        best = max((k for k in range(1, 13) if k <= end and 0 not in plain[end - k : end] and often(k) > 1), default=0)
        assert n == best


@pytest.mark.parametrize("width", [8, 20, 40])
def test_substrings_of_any_width(spark, width):
    rng = np.random.default_rng(width)
    head = [f"h{i}" for i in range(35)]  # alike for 35 words, then not
    rows = [(i, " ".join(head + [f"r{x}" for x in rng.integers(0, 9, 60)] + head[: i % 36])) for i in range(40)]
    got = [tuple(r) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), width=width).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got) == brute.substrings(rows, width)


def test_substrings_defined_cases(odd):
    got = {}
    for r in substring_dedup.dedup_substrings(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["text"]))
    assert got[2] == [(0, 0, "")] and got[3] == [(0, 0, "")] and got[9] == [(0, 0, "")] and got[None] == [(7, 0, "a b c d e f g")]
    assert len(got[5]) == 2 and got[4] == [(60_000, 0, LONG)] and got[13] == [(60_001, 60_000, "tail")]


def test_near_copies(spark, small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.NearDedup()(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got == brute.near([x[:2] for x in small])


@pytest.mark.parametrize("hot", [10_000, 1])
def test_near_copies_in_crowded_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "_BLOCK", 8)
    monkeypatch.setattr(common, "_HOT", hot)
    rng = np.random.default_rng(5)
    bases = [[f"w{x}" for x in rng.integers(0, 500, 150)] for _ in range(2)]
    rows = []
    for i in range(160):
        words = list(bases[i % 2])
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            words[at] = f"c{i}-{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.NearDedup()(df).collect()}
    assert got == brute.near(rows)


def test_rows_of_one_id_keep_all_links(spark):
    """Two texts under one id: the links of both count."""
    rng = np.random.default_rng(8)
    a, b = ([f"w{x}" for x in rng.integers(0, 9999, 80)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (9, "z " * 9)]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.NearDedup()(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (7, 3), (3, 3), (9, 9)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    y = np.concatenate([x[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    same = (near_dedup.fast_sketch(x, 216) == near_dedup.fast_sketch(y, 216)).mean()
    assert abs(same - 800 / 1200) < 0.12
    for n in (1, 2, 50):  # every coordinate fills
        assert (near_dedup.fast_sketch(x[:n], 216) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_near_copies_defined_cases(odd):
    got = {}
    for r in near_dedup.NearDedup()(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[2] == got[3].__class__([(0, 2, True)]) and got[3] == [(0, 3, True)] and got[9] == [(0, 9, True)]
    assert got[None] == [(3, 1, True)] or got[None] == [(3, None, True)]
    assert got[10] == [(1, 10, True)] and got[11] == [(1, 10, False)] and got[5] == [(got[5][0][0], 5, True)] * 2 and got[13][0][1:] == (4, False)


def test_mix(spark, small, odd):
    for rows, df in (([(i, s, len(brute.WORD.findall(t or ""))) for i, t, s in small], spark.read.parquet(f"{DATA}/documents.parquet")), ([(r["doc_id"], r["source"], len(brute.WORD.findall(r["text"] or ""))) for r in odd.collect()], odd)):
        got = [tuple(r) for r in mixing.mix_sources(df).select("id", "size", "source_size", "target", "copies").collect()]
        order = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
        for a, b in zip(sorted(got, key=order), sorted(brute.mix(rows), key=order), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4] and a[4] <= 2
        taken = mixing.take_copies(df)
        assert taken.columns == df.columns and taken.count() == sum(r[4] for r in got)


def test_mix_comes_near_targets(spark):
    rows = mixing.op4_mix_sources(spark, DATA.replace("sf0.001", "sf0.01")).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert rows and all(abs(r["t"] - r["target"]) <= 0.05 * r["target"] + 2000 for r in rows)


@pytest.fixture(scope="module")
def reference_bpe():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_ranks(path), special_tokens={})


def bpe_ranks(path):
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ids_of(encoding, text):
    return np.array(encoding.encode(text or "", disallowed_special=()), "<u4").tobytes()


@pytest.mark.parametrize(("chunk", "overlap", "spread"), [(1024, 128, 262_144), (50, 25, 262_144), (64, 16, 100), (7, 7, 50)])
def test_bpe(spark, odd, small, reference_bpe, chunk, overlap, spread):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    extra = [
        (20, "<|endoftext|> it's  \n\n 12  x" * 30, None, None), (21, "y" * 400, None, None), (22, "日本 語" * 50, None, None), (23, " " * 300 + "z", None, None),
        (24, "a b " * 20 + "y" * 700 + " c d" * 30, None, None), (25, "x\x1c\x85y \u3000 z\u2028" * 60, None, None), (26, "\U00031350 𞤀𞤁 \u1c89 ꟑ\U0001ccf0 " * 40, None, None),
    ]
    df = frame(spark, extra).unionByName(odd.where("doc_id is null or doc_id <> 13 and doc_id <> 4") if spread < 1000 else odd)
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_texts(df, bpe.vocabulary(), chunk=chunk, overlap=overlap, spread=spread).collect()]
    want = [(i, len(ids_of(reference_bpe, t)) // 4, ids_of(reference_bpe, t), (t or "").encode()) for i, t in pairs(df)]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_bpe_pieces_are_many(small):
    codec = bpe.Codec.at(bpe.vocabulary())
    for _, text, _ in small:
        pieces = list(codec.pieces(text or "", 256, 64))
        assert "".join(pieces) == (text or "") and len(pieces) >= len(text or "") // 512


def test_bpe_query(spark, small, reference_bpe):
    got = sorted(tuple(r) for r in bpe.op5_byte_bpe(spark, DATA).collect())
    assert got == sorted((i, len(ids_of(reference_bpe, t)) // 4, brute.sha(ids_of(reference_bpe, t)), brute.sha(t or "")) for i, t, _ in small)


def test_pii_query(spark, small):
    got = {r["doc_id"]: r for r in pii.op7_pii(spark, DATA).collect()}
    assert len(got) == len(small)
    for i, text, _ in small:
        base = brute.personal(text)
        assert got[i]["base_sha256"] == brute.sha(",".join(base))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]
        assert set(base) <= set(got[i]["spans"].split(","))


@pytest.mark.parametrize(
    "text",
    ["a@b.c d@e", "x.y@z-1.co.uk.", "a@@b.c", "1.2.3.4.5.6.7.8", "300.1.1.1 01.002.3.4", "4111 1111 1111 1111 5", "4111-1111-1111-1111", "+1 (555) 010-9999.", "++49 30 123456-", "@b.c", "a@b.c@d.e", "+1+2345678901", "", "1.2.3.999.1.1.1"],
)
def test_pii_base(text):
    found = pii.base_spans(text)
    assert [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k]] == brute.personal(text)


def test_pii_proposals_and_cases(spark, odd):
    judge = pii.train()
    df = spark.createDataFrame([(1, "mail: john.smith at mailbox dot org now"), (2, "built 2021-03-04 10:22:33, version 1.2.3"), (3, None), (3, None), (None, "call (555) 123-4567")], "doc_id long, text string")
    got = pii.find_pii(df, judge, redact=True).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and [s["kind"] for s in by[1]["spans"]] == ["email"] and by[2]["spans"] == [] and by[3]["spans"] == [] and by[None]["redacted"] == "call [phone]"
    assert pii.find_pii(odd, judge).count() == odd.count()


def test_shards(spark, odd):
    for df in (odd, spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")):
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == df.count() and {r["law"] for r in rows} == {"bytes"}
        of = {}
        for r in rows:
            of.setdefault(r["shard"], []).append(r)
        assert set(of) <= set(range(16)) and all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in of.values())
        assert len({(r["text_crc32"], r["size"], r["shard"]) for r in rows}) == len({(r["text_crc32"], r["size"]) for r in rows})
    sizes = [sum(x["size"] for x in v) for v in of.values()]
    assert len(of) == 16 and max(sizes) <= 1.15 * sum(sizes) / 16


def test_toxicity(spark):
    sf = DATA.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    good = np.mean([r["predicted"] == r["toxic"] for r in scored])
    toxic = [r["score"] for r in scored if r["toxic"] == 1]
    clean = [r["score"] for r in scored if r["toxic"] == 0]
    auc = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert len(toxic) > 20 and good >= 0.93 and auc >= 0.93


def test_toxicity_learns_nothing_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ([r["score"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, x)).orderBy("doc_id").collect()] for x in (labels, turned))
    assert a == b and all(0 <= x <= 1 for x in a)


def test_toxicity_defined_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = toxicity.score_toxicity(odd, toxicity.train(odd, labels), carry=("score", "id")).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1


def test_empty_tables(spark):
    none = frame(spark, [(1, "x", None, None)]).where("doc_id > 1")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        line_dedup.dedup_lines(none), substring_dedup.dedup_substrings(none), mixing.mix_sources(none), mixing.take_copies(none), bpe.encode_texts(none, bpe.vocabulary()),
        pii.find_pii(none, pii.train()), near_dedup.NearDedup()(none), sharding.shard_documents(none), toxicity.score_toxicity(none, toxicity.train(none, labels)),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_digests_are_of_whole_texts(spark, small):
    got = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.op3_substring_dedup(spark, DATA).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in brute.substrings([x[:2] for x in small])}
