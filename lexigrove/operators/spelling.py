"""Questions with their misspelt words corrected: acronyms and terms of the domain first, then words of a corpus.

Every distinct word is judged once. Words of the domain are few and judged against a small table; all others meet the
corpus's vocabulary in a join on shared segments, so no word is held against all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions.text import strip, text_of

#: Acronyms, terms and known misspellings of the domain, as they are written.
ACRONYMS = {"aks": "AKS", "vm": "VM", "vms": "VMs", "ai": "AI", "ml": "ML", "rag": "RAG", "api": "API", "rbac": "RBAC", "sla": "SLA", "dr": "DR", "bc": "BC"}
TERMS = {
    "azure": "Azure", "cloud": "cloud", "computing": "computing", "databricks": "Databricks", "kubernetes": "Kubernetes", "devops": "DevOps",
    "entra": "Entra", "cosmos": "Cosmos", "cosmosdb": "CosmosDB", "serverless": "serverless", "finops": "FinOps", "reliability": "reliability",
    "resiliency": "resiliency", "availability": "availability", "scalability": "scalability", "security": "security", "governance": "governance",
    "architecture": "architecture", "workload": "workload", "storage": "storage", "container": "container", "containers": "containers",
    "monitor": "Monitor", "advisor": "Advisor",
}
ALIASES = {
    "clod": "cloud", "claud": "cloud", "computin": "computing", "compoting": "computing", "databrikc": "Databricks", "databrick": "Databricks",
    "databrik": "Databricks", "kuburnit": "Kubernetes", "kubernet": "Kubernetes", "kubernets": "Kubernetes", "kubernete": "Kubernetes",
    "reliabiliti": "reliability", "reliabilty": "reliability", "scalabiliti": "scalability", "scalabilty": "scalability", "azur": "Azure",
}
#: The least likeness of an acronym, and that of a term by the word's length.
ACRONYM_SCORE = 65
TERM_SCORES = ((8, 62), (5, 68), (0, 78))

WORD = r"[A-Za-z][A-Za-z0-9_-]*"
_TOKEN = rf"({WORD}|\p{{Nd}}+|[^\p{{L}}\p{{N}}_\s])"


def likeness(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def part_likeness(a: str, b: str) -> float:
    """Likeness of whole words, or nine tenths (six, if over 8 times as long) of the best part of the longer one."""
    short, long = sorted((a, b), key=len)
    n, spread = len(short), len(long) / max(len(short), 1)
    best = likeness(a, b)
    if spread < 1.5 or not n:
        return best
    ends = [(max(0, e - n), min(e, len(long))) for e in range(1, len(long) + n)]
    return max(best, (0.9 if spread <= 8 else 0.6) * max(likeness(short, long[s:e]) for s, e in ends))


def domain_form(word: str) -> str | None:
    """The acronym or term that a lower-case word is or nearly is. A word so long that no term can come near is none.

    Parts count, so a short word inside a term is taken for the term.
    """
    if word in ACRONYMS:
        return ACRONYMS[word]
    if 2 <= len(word) <= 5:
        near = max(ACRONYMS, key=lambda a: likeness(word, a))
        if likeness(word, near) >= ACRONYM_SCORE:
            return ACRONYMS[near]
    if found := TERMS.get(word) or ALIASES.get(word):
        return found
    if len(word) > 8 * max(map(len, TERMS)):  # six tenths of any likeness are below the least score
        return None
    near = max(TERMS, key=lambda t: part_likeness(word, t))
    return TERMS[near] if part_likeness(word, near) >= next(s for n, s in TERM_SCORES if len(word) >= n) else None


@F.pandas_udf(T.StringType())
def _domain(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(domain_form)


def _parts(words: DataFrame, length: Column) -> DataFrame:
    """Rows with i, start and size: the i-th of three parts of a word as long as `length`, its place from 0 and its size."""
    at = lambda i: F.floor(length * i / 3).cast("int")
    cut = words.withColumn("n", length).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return cut.withColumns({"start": at(F.col("i")), "size": at(F.col("i") + 1) - at(F.col("i"))})


def _keys_known(words: DataFrame) -> DataFrame:
    """Each word's three parts: (word, n, i, part)."""
    return _parts(words, F.length("word")).withColumn("part", F.substring("word", F.col("start") + 1, F.col("size"))).drop("start", "size")


def _keys_asked(words: DataFrame) -> DataFrame:
    """The parts of all words within two edits: one of theirs is then in this one, moved by two places at most."""
    near = F.sequence(F.lit(-2), F.lit(2))
    longer = words.withColumn("more", F.explode(near)).where(F.length("word") + F.col("more") > 0)
    moved = _parts(longer, F.length("word") + F.col("more")).withColumn("at", F.explode(F.transform(near, lambda m: m + F.col("start"))))
    fits = moved.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.length("word")))
    return fits.select("word", "n", "i", F.substring("word", F.col("at") + 1, F.col("size")).alias("part")).distinct()


def _swapped(a: Column, b: Column) -> Column:
    """Whether two words of one length differ by two neighbours that changed places."""
    at = F.sequence(F.lit(1), F.length(a) - 1)
    turned = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(at, lambda i: turned(i) == b)


def corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """words(word), distinct, and known(word, n) to (word, corrected) of words that are not known but near one that is:
    one edit or a swap of neighbours before two edits, then the most frequent, then the first by code points."""
    strange = _keys_asked(words.join(known, "word", "left_anti").select("word"))
    near = _keys_known(known.select("word", F.col("n").alias("uses"))).withColumnRenamed("word", "other")
    edits = F.levenshtein("word", "other", 2)
    pairs = strange.join(near, ["n", "i", "part"]).select("word", "other", "uses", edits.alias("edits")).where("edits between 1 and 2")
    rank = F.when((F.col("edits") == 1) | _swapped(F.col("word"), F.col("other")), 1).otherwise(2)
    best = pairs.groupBy("word").agg(F.min(F.struct(rank.alias("rank"), (-F.col("uses")).alias("uses"), F.col("other").alias("corrected"))).alias("best"))
    return best.select("word", "best.corrected")


def vocabulary(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """known(word, n): the words of a corpus in lower case, in use at least `least` times."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(rf"({WORD.replace('A-Z', '')})"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _case_of(original: Column, corrected: Column) -> Column:
    first = F.left(original, F.lit(1))
    upper = F.concat(F.upper(F.left(corrected, F.lit(1))), F.substring(corrected, F.lit(2), F.length(corrected)))
    return F.when(F.upper(original) == original, F.upper(corrected)).when(F.upper(first) == first, upper).otherwise(corrected)


def correct(questions: DataFrame, known: DataFrame, text_col: str = "question") -> DataFrame:
    """questions(query_id, question) to (query_id, corrected): words, numbers and signs by single blanks, none before
    closing signs or after opening brackets. A question without any of them, or null, becomes empty."""
    at = F.posexplode_outer(F.regexp_extract_all(strip(text_of(text_col)), F.lit(_TOKEN), F.lit(1))).alias("at", "token")
    tokens = questions.select("query_id", at).withColumn("word", F.when(F.col("token").rlike(f"^{WORD}$"), F.lower("token")))
    words = tokens.where("word is not null").select("word").distinct()
    special = words.select("word", _domain("word").alias("special"))
    plain = corrections(special.where("special is null and length(word) > 2").select("word"), known)
    told = tokens.join(special.join(plain, "word", "left"), "word", "left")
    form = F.coalesce("special", _case_of(F.col("token"), F.col("corrected")), "token")
    parts = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", form.alias("form")))).alias("parts"))
    line = F.array_join(F.transform("parts", lambda p: p["form"]), " ")
    for pattern, to in ((r"\s+([?.!,;:])", "$1"), (r"([(\[])\s+", "$1"), (r"\s+([)\]])", "$1")):
        line = F.regexp_replace(line, pattern, to)
    return parts.select("query_id", line.alias("corrected"))
