"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The labels of a bounded sample are learned from in two ways: which words and word beginnings and endings go with
the label (the lexicon), and how the densities of the lexicon and of second persons near it, capitals, punctuation
and obfuscation do (the trees). Sample, lexicon and model are small and fixed in size; every text is then scored
whole, in its own partition, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.boost import Boosted, Isotonic
from lexigrove.llm.common import Scratch, documents, map_rows, with_fields

FEATURES = (
    "words", "strong_hits", "strong_density", "weak_hits", "weak_density", "strong_distinct", "near_second_person", "capital_letters",
    "capital_words", "exclaim", "question", "punctuation", "repeated_punctuation", "obfuscated", "obfuscated_hits", "spaced_hits", "digits",
    "word_length", "densest",
)
_WORD = re.compile(r"[^\W_]+")
_MASK = re.compile(r"[@$!|*0134578][^\W\d_]")  # in every masked word
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[@$!|*0134578]++[^\W\d_]++)+|(?<![@$0134578])[@$0134578]++[^\W\d_]{2,}")
_CAPITAL_WORD = re.compile(r"(?<![^\W_])[^\W_a-z]++(?![^\W_])")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_REPEATED = re.compile(r"[!?.*#%&$]{2,}")
_PLAIN = str.maketrans("@$!|0134578", "asiloieastb")
#: Words for the person spoken to.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo tus os vuestro".split())


def terms(word: str) -> list[str]:
    """A word, and its beginnings and endings of 4 to 6 letters, marked by a star."""
    out = [word]
    for k in (4, 5, 6):
        if len(word) > k:
            out += (word[:k] + "*", "*" + word[-k:])
    return out


_POINTS = (*range(0xD800), *range(0xE000, 0x110000))


@lru_cache(1)
def marks() -> np.ndarray:
    """For each code point, whether it is neither a word character nor white space."""
    out = np.zeros(0x110000, bool)
    out[np.frombuffer(re.sub(r"[\w\s]+", "", "".join(map(chr, _POINTS))).encode("utf-32-le"), "<u4")] = True
    return out


@lru_cache(1)
def capitals() -> np.ndarray:
    """For each code point, whether its lower case is another."""
    out = np.zeros(0x110000, bool)
    out[[i for i in _POINTS if chr(i).lower() != chr(i)]] = True
    return out


class Features:
    """A text's features under a lexicon {term: strength}, 2 for strong and 1 for weak terms."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.known: dict[str, int] = {}

    def strength(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = max((self.lexicon.get(t, 0) for t in terms(word)), default=0)
            if len(self.known) > 60_000:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = found
        return found

    def __call__(self, text: str) -> list[float]:
        lower = text.lower()
        words = _WORD.findall(lower)
        n, chars = max(len(words), 1), max(len(text), 1)
        strength, known = self.strength, self.known.get
        levels = [s if (s := known(w)) is not None else strength(w) for w in words]
        strong = [i for i, s in enumerate(levels) if s == 2] if 2 in levels else []
        weak = levels.count(1)
        near = sum(1 for i in strong if not SECOND_PERSON.isdisjoint(words[max(0, i - 4) : i + 5])) if strong else 0
        densest = 0  # strong words within fifty words; fifty of them at most, as more say no more
        for k, i in enumerate(strong):
            last = k
            while last + 1 < len(strong) and strong[last + 1] < i + 50 and last - k < 50:
                last += 1
            densest = max(densest, last - k + 1)
        lengths = list(map(len, words))
        masked = _MASKED.findall(lower) if _MASK.search(lower) else []
        masked_hits = sum(1 for m in masked if "@" not in m[1:] or "." not in m for w in (m.translate(_PLAIN),) if strength(w) == 2)
        spaced = _SPACED.findall(lower) if lengths.count(1) >= 4 else []
        spaced_hits = sum(1 for m in spaced if strength(re.sub(r"[ .\-_*]", "", m)) == 2)
        upper = sum(map(str.isupper, _CAPITAL_WORD.findall(text))) if text != lower else 0
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        punctuation = int(marks()[points].sum())
        return [
            np.log1p(len(words)), np.log1p(len(strong)), 100 * len(strong) / n, np.log1p(weak), 100 * weak / n, len({words[i] for i in strong}),
            near, int(capitals()[points].sum()) / chars if text != lower else 0.0, upper / n, text.count("!") / n, text.count("?") / n, punctuation / chars,
            len(_REPEATED.findall(text)) / n, len(masked) / n, masked_hits, spaced_hits, sum(map(text.count, "0123456789")) / chars,
            sum(lengths) / n, densest,
        ]


class Model:
    def __init__(self, lexicon: dict[str, int], trees: Boosted, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, features: list[list[float]]) -> np.ndarray:
        raw = self.trees.raw(np.array(features, float))
        return np.clip(self.calibration(raw), 0.0, 1.0) if len(self.calibration.x) else 1 / (1 + np.exp(-raw))


def held_out(id_col: Column) -> Column:
    """Every fifth document or so, by its id's checksum: never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


_FOLDS = 4


def lexicons(counted: DataFrame, totals: list[tuple[int, int]], without: list[tuple[int, ...]], max_terms: int) -> dict[tuple[int, ...], dict[str, int]]:
    """For each set of folds in `without`, the lexicon that the other folds' labels give.

    counted has (term, a0 .., b0 ..): in how many documents with and without the label a term is, by fold. A lexicon
    has the max_terms terms that go most surely with the label.
    """

    def judged(gone: tuple[int, ...]) -> DataFrame:
        left = [f for f in range(_FOLDS) if f not in gone]
        pos, neg = (max(sum(totals[f][k] for f in left), 1) for k in (0, 1))
        a, b = (sum((F.col(f"{k}{f}") for f in left), F.lit(0)) for k in "ab")
        both = counted.select("term", a.alias("a"), b.alias("b"), F.lit(without.index(gone)).alias("set"))
        share = (F.col("a") + F.col("b")) / F.lit(float(pos + neg))
        z = (F.col("a") / F.lit(float(pos)) - F.col("b") / F.lit(float(neg))) / F.sqrt(share * (1 - share) * F.lit(1 / pos + 1 / neg) + 1e-12)
        return both.where("a >= 5").withColumn("z", z).where("z > 5")

    best = Window.partitionBy("set").orderBy(F.desc("z"), "term")
    picked = reduce(DataFrame.unionByName, map(judged, without)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_terms)
    out: dict[tuple[int, ...], dict[str, int]] = {gone: {} for gone in without}
    for r in picked.where("a >= 0.7 * (a + b)").collect():  # at most max_terms rows for each set
        # as often as chance would have it, a term in few documents goes with the label: strong ones need more
        out[without[r["set"]]][r["term"]] = 2 if r["a"] >= 8 and r["a"] >= 0.98 * (r["a"] + r["b"]) and r["z"] >= 6 else 1
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_terms: int = 400) -> Model:
    """Learn from at most max_rows labelled rows that aren't held out, the first by a hash of the id.

    What is learned is fitted crosswise in four folds by a hash of the id. The trees see a row's features under a
    lexicon that its fold had no part in. The calibration of a fold comes from a lexicon and trees that the fold had
    no part in, and the trees in turn saw features under lexicons without their rows' folds. The lexicon that scores
    comes from all rows. max_terms bounds what a term's place in the lexicon can cost, not what is scored.
    Without any usable label nothing speaks for label 1, and every score is 0.001; from few labels of one kind, scores
    are near that label.
    """
    return fit(docs, labels, id_col, text_col, label_col, max_rows, max_terms)[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_terms: int) -> tuple[Model, list[tuple[dict[str, int], Boosted]]]:
    """The model, and the lexicon and trees that calibrated each fold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    sample = usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most max_rows pairs of numbers are sent to every task
    texts = scratch.save(texts.join(F.broadcast(sample), "id").select("id", "y", "text", F.pmod(F.xxhash64("id"), F.lit(_FOLDS)).cast("int").alias("fold")), "sample")

    def count(rows: Iterator[dict]) -> Iterator[tuple]:
        held = [Counter() for _ in range(2 * _FOLDS)]
        told = lambda: ((t, n, k // 2, k % 2) for k, c in enumerate(held) for t, n in c.items())
        for row in rows:
            held[2 * row["fold"] + (row["y"] == 1)].update({t for w in set(_WORD.findall(row["text"].lower())) for t in terms(w)})
            if sum(map(len, held)) > 300_000:
                yield from told()
                held = [Counter() for _ in range(2 * _FOLDS)]
        yield from told()

    of = lambda k, f: F.sum(F.when((F.col("y") == k) & (F.col("fold") == f), F.col("n")).otherwise(0))
    counted = map_rows(texts, count, "term string, n long, fold int, y int").groupBy("term").agg(*[of(1, f).alias(f"a{f}") for f in range(_FOLDS)], *[of(0, f).alias(f"b{f}") for f in range(_FOLDS)])
    counted = scratch.save(counted.where("+".join(f"a{f}" for f in range(_FOLDS)) + " >= 5"), "terms")
    sizes = {r["fold"]: (r["a"], r["b"]) for r in texts.groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).collect()}  # a row for each fold
    without = [s for n in range(3) for s in combinations(range(_FOLDS), n)]
    found = lexicons(counted, [sizes.get(f, (0, 0)) for f in range(_FOLDS)], without, max_terms)

    def measure(rows: Iterator[dict]) -> Iterator[tuple]:
        measured = {gone: Features(found[gone]) for gone in without}
        for row in rows:
            fold = row["fold"]  # place k: without the row's fold and fold k
            yield row["id"], row["y"], fold, [measured[tuple(sorted({fold, k}))](row["text"]) for k in range(_FOLDS)]

    got = map_rows(texts, measure, f"id {texts.schema['id'].dataType.simpleString()}, y int, fold int, x array<array<double>>").orderBy("fold", "id").collect()  # at most max_rows rows of numbers
    x, y, fold = np.array([r["x"] for r in got], float).reshape(-1, _FOLDS, len(FEATURES)), np.array([r["y"] for r in got], float), np.array([r["fold"] for r in got], int)
    own = x[np.arange(len(x)), fold]
    raw, apart = np.zeros(len(y)), []
    for k in range(_FOLDS):
        trees = Boosted().fit(x[fold != k, k], y[fold != k])
        raw[fold == k] = trees.raw(own[fold == k])
        apart.append((found[(k,)], trees))
    trees = Boosted().fit(own, y)
    if not len(y):
        trees.start = float(np.log(0.001 / 0.999))
    return Model(found[()], trees, Isotonic().fit(raw, y)), apart


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, score, predicted, then the carried columns) for each row: nothing but the text decides.

    Defined cases: null texts score as empty ones; a text of any length is one row and scored whole; repeated rows
    score alike; a null id is carried along; an empty table gives an empty one; columns that are not named are
    ignored, and a carried column named like a result column is left out.
    """
    carry = tuple(c for c in carry if c not in (id_col, "score", "predicted"))

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        measured = Features(model.lexicon)
        held: list = []

        def flush() -> Iterator[tuple]:
            for (row, _), s in zip(held, model.score([f for _, f in held])):
                yield row["id"], float(s), int(s >= 0.5), *(row[f"c{i}"] for i in range(len(carry)))

        for row in rows:
            features = measured(row.pop("text") or "")
            held.append((row, features))
            if len(held) == 256:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    to = with_fields(f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int", docs, carry)
    return map_rows(src, run, to).toDF(id_col, "score", "predicted", *carry)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
