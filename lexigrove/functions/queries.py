"""What stands around a model: questions normalised and expanded, outputs checked, answers taken out and shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.functions.text import once, strip, text_of, tokens


def expanded(normalised: Column, original: Column) -> Column:
    """The lexical query: the normalised question, and the original on a line of its own where they differ."""
    return F.when(normalised == original, normalised).otherwise(F.concat_ws("\n", normalised, original))


def prefixed(c: Column, kind: str) -> Column:
    """A text as an encoder takes it: kind is "query" or "passage"."""
    return F.concat(F.lit(f"{kind}: "), text_of(c))


def final_answer(c: Column) -> Column:
    """What stands in the first <final> element; an output without one fails."""
    found = F.regexp_extract(text_of(c), r"(?is)<final>\s*(.*?)\s*</final>", 1)
    return F.when(text_of(c).rlike(r"(?is)<final>.*?</final>"), found).otherwise(F.raise_error(F.lit("an output has no final answer")))


def rewrite_accepted(output: Column, question: Column) -> Column:
    """Whether a model's rewrite of a question may replace it: one line, not empty, of at most max(160, 8 n) characters."""
    out = strip(text_of(output))
    return (out != "") & ~out.rlike(r"[\r\n]") & (F.length(out) <= F.greatest(F.lit(160), F.length(text_of(question)) * 8))


def to_boolean(c: Column) -> Column:
    """true, 1, yes, y, on and their opposites; anything else is null."""
    form = F.lower(strip(text_of(c.cast("string"))))
    return F.when(form.isin("true", "1", "yes", "y", "on"), True).when(form.isin("false", "0", "no", "n", "off"), False)


def to_optional_double(c: Column) -> Column:
    """Null for an empty text and for one that is no number."""
    return F.nullif(strip(text_of(c)), F.lit("")).try_cast("double")


def bytes_text(c: Column) -> Column:
    """A size with its unit, one digit after the point from kilobytes on."""
    size = c.cast("double")
    out = F.concat(c.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024.0**k, F.concat(F.format_string("%.1f", size / 1024.0**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def first_filled(values: Column, *keys: str) -> Column:
    """The first of a map's values that is not blank."""
    return F.coalesce(*[F.nullif(strip(text_of(F.try_element_at(values, F.lit(k)))), F.lit("")) for k in keys])


def first_tokens(c: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ") if n else F.lit("")


def last_tokens(c: Column, n: int) -> Column:
    return once(tokens(c), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, F.lit(n)), " ")) if n else F.lit("")


def split_by_tokens(c: Column, n: int) -> Column:
    """The text in pieces of n tokens."""
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / n), F.lit(1)).cast("int") - 1)
    return once(tokens(c), lambda w: F.filter(F.transform(starts(w), lambda i: F.array_join(F.slice(w, i * n + 1, F.lit(n)), " ")), lambda x: x != ""))


def title(*candidates: Column, path: Column) -> Column:
    """The first candidate that is not blank, else the file's name in words with capitals."""
    stem = F.regexp_replace(F.element_at(F.split(F.replace(text_of(path), F.lit("\\"), F.lit("/")), "/"), -1), r"\.[^.]*$", "")
    named = F.initcap(strip(F.regexp_replace(stem, r"[-_]+", " ")))
    return F.coalesce(*[F.nullif(strip(text_of(c)), F.lit("")) for c in candidates], named)


def document_id(source_id: Column, path: Column) -> Column:
    """source:stem in lower case; files of one stem in two folders share it."""
    stem = F.regexp_replace(F.element_at(F.split(F.replace(text_of(path), F.lit("\\"), F.lit("/")), "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws(":", source_id, F.lower(stem))


def front_matter(c: Column) -> Column:
    """struct(values map, body): the block between --- lines at the text's start, a `key: value` each line."""
    text = F.regexp_replace(text_of(c), r"\r\n?", "\n")
    block = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)"
    lines = F.filter(F.split(F.regexp_extract(text, block, 1), "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.-]*:"))
    unquoted = lambda v: F.regexp_replace(strip(v), "^([\"'])(.*)\\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]*):", 1).alias("key"), unquoted(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    once = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.struct(F.map_from_entries(once).alias("values"), F.regexp_replace(text, block, "").alias("body"))


#: What a model puts before a normalised question, what marks an answer in its place, and the lines it starts with.
LABEL = r"(?i)^(?:normalized query|normalized|output)\s*:\s*"
ANSWER = r"(?i)^(?:answer|explanation|the answer|here(?:'s| is)|certainly|sure)\s*[:,-]"
MARKUP = ("- ", "* ", "#")
#: Where a chunk's metadata may keep its address.
URL_KEYS = ("url", "source_url", "canonical_url", "document_url", "web_url")
#: Fixed value: citations that only a program reads.
TECHNICAL = r"(?i)\[(?=[^\[\]\r\n]*(?:\.(?:pdf|md|html?|txt)\s*:|__chunk_\d+))[^\[\]\r\n]+\]"


def normalised_output(output: Column, original: Column) -> Column:
    """A model's normalised question, out of its fence, label and quotes; null where it is none: empty, of several lines,
    longer than max(120, 3 n) characters, an answer or markup."""
    bare = strip(F.regexp_replace(strip(text_of(output)), r"^```(?:text)?\s*|\s*```$", ""))
    bare = strip(F.regexp_replace(bare, LABEL, ""))
    quoted = (F.length(bare) >= 2) & (F.left(bare, F.lit(1)) == F.right(bare, F.lit(1))) & F.left(bare, F.lit(1)).isin('"', "'")
    bare = F.when(quoted, strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    wrong = (bare == "") | bare.rlike(r"[\r\n]") | (F.length(bare) > F.greatest(F.lit(120), F.length(text_of(original)) * 3)) | bare.rlike(ANSWER)
    for mark in MARKUP:
        wrong = wrong | bare.startswith(mark)
    return F.when(~wrong, bare)


def source_url(metadata: Column) -> Column:
    return first_filled(metadata, *URL_KEYS)


def display(answer: Column) -> Column:
    """An answer as it is shown: without technical citations, single blanks, none before punctuation, at most one empty line."""
    out = F.regexp_replace(text_of(answer), TECHNICAL, "")
    for pattern, to in ((r"[ \t]{2,}", " "), (r"[ \t]+([,.;:!?])", "$1"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)
