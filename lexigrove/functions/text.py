"""Text functions as column expressions. All stay in the JVM but for Unicode normalisation, where a text may need it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's str.strip and str.split take as white space, for Java's and RE2's expressions alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Words that a lexical query leaves out.
STOPWORDS = ("a an and are as at be by can do does for from how in is it of on or should the to what when where which who why with").split()

#: Lines that are navigation and not content, compared after `boilerplate_form`.
BOILERPLATE = (
    "edit", "edit this page", "edit on github", "feedback", "submit feedback", "previous", "next", "table of contents",
    "in this article", "sign in", "sign out", "print", "share", "learn", "skip to main content", "was this page helpful",
    "is this page helpful", "need help", "additional resources", "related content", "related articles", "privacy",
    "terms of use", "trademarks",
)
BOILERPLATE_PATTERN = (
    r"^(?:©\s*\d{4}.*|copyright\s+\d{4}.*|last updated[:\s].*|updated[:\s].*|page last reviewed[:\s].*|this page was last updated.*"
    r"|contribute to this page.*|open a documentation issue.*|view all page feedback.*)$"
)
BOILERPLATE_URL = r"/feedback|github\.com/microsoftdocs|#feedback|/legal/|/privacy|/terms"

#: Spaces, invisible characters, quotes, dashes and dots, and what they become.
REPLACED = (
    ("               　", " "),
    ("᠎​‌‍⁠﻿­", ""),
    ("‘’‚‛′", "'"),
    ("“”„‟″", '"'),
    ("‐‑‒–—―−", "-"),
    ("…", "..."),
    ("·", "."),
)


def _accents() -> tuple[str, str]:
    """Latin letters that are a plain letter with marks, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.category(x) == "Mn" for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of an expression that is evaluated once, however often fn names it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def spaced(c: Column) -> Column:
    """All white space as blanks, character by character: many times faster than a class of so many ranges."""
    return F.translate(c, SPACES, " " * len(SPACES))


def clean_inline(c) -> Column:
    """One line: line ends become spaces, runs of blanks one space, ends stripped."""
    c = F.regexp_replace(text_of(c), r"\r\n|\r|\n", " ")
    return strip(F.regexp_replace(c, r"[ \t\f\x0b]+", " "))


def clean_multiline(c) -> Column:
    """Lines stripped, at most one blank line between them."""
    c = F.regexp_replace(F.regexp_replace(text_of(c), r"\r\n|\r", "\n"), r"\x00", "")
    c = F.regexp_replace(c, r"[ \t\f\x0b]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_code(c) -> Column:
    """Indentation stays; trailing blanks and blank first and last lines go."""
    c = F.regexp_replace(F.regexp_replace(text_of(c), r"\r\n|\r", "\n"), r"\x00", "")
    c = F.regexp_replace(c, r"[\t\x0b\f ]+\n", "\n")
    return F.rtrim(F.regexp_replace(c, r"^(?:[\t\x0b\f ]*\n)+", ""), F.lit(SPACES))


def boilerplate_form(c) -> Column:
    c = F.regexp_replace(spaced(F.lower(strip(text_of(c)))), " +", " ")
    return F.regexp_replace(c, r"^[ \t\r\n:;,.!?–—|\-]+|[ \t\r\n:;,.!?–—|\-]+$", "")


def is_boilerplate_form(form: Column, lines: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Of a text in its compared form: one of the fixed lines and patterns, or of further ones, which match as a whole.
    Where there are many texts, keep the form in a column: it is used several times here."""
    every = sorted({*BOILERPLATE, *map(_compared, lines)} - {""})
    found = form.isin(*every) | form.rlike(BOILERPLATE_PATTERN)
    for pattern in patterns:
        found = found | form.rlike(f"^(?:{pattern})$")
    return (form != "") & found


def _compared(line: str) -> str:
    return " ".join(line.lower().split()).strip(" :;,.!?–—|-")


def is_boilerplate(c, lines: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    return is_boilerplate_form(boilerplate_form(c), lines, patterns)


def is_boilerplate_url(c, patterns: tuple[str, ...] = ()) -> Column:
    return F.lower(strip(text_of(c))).rlike("|".join([BOILERPLATE_URL, *patterns]))


def dedup_form(c) -> Column:
    return F.lower(F.regexp_replace(spaced(strip(text_of(c))), " +", " "))


def fingerprint_of(form: Column) -> Column:
    """SHA-256 of a compared form; empty where there is nothing to compare."""
    return F.when(form == "", "").otherwise(F.sha2(form, 256))


def fingerprint(c) -> Column:
    return fingerprint_of(dedup_form(c))


@F.pandas_udf(T.StringType())
def clean_unicode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility folding, then the fixed replacements, then no control characters but line ends."""
    table = {ord(c): to for chars, to in REPLACED for c in chars}
    for batch in texts:
        out = []
        for t in batch:
            t = unicodedata.normalize("NFKC", t or "").translate(table)
            if not t.isprintable():
                t = "".join(c for c in t if c in "\n\r" or unicodedata.category(c)[0] != "C")
            out.append(t.strip())
        yield pd.Series(out)


@F.pandas_udf(T.StringType())
def fold_compatibility(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Letters of Latin 1 that folding leaves alone are not in this class; all others may change by it.
_MAY_FOLD = r"[\x{a0}\x{a8}\x{aa}\x{af}\x{b2}-\x{b5}\x{b8}-\x{ba}\x{bc}-\x{be}\x{100}-\x{10ffff}]"


def compatible(c: Column) -> Column:
    """Compatibility folding (NFKC). Only texts that it may change travel to Python."""
    return F.coalesce(fold_compatibility(F.when(c.rlike(_MAY_FOLD), c)), c)


def evaluation_form(c) -> Column:
    """Compatibility folding, dashes, quotes and spaces unified, lower case, single spaces."""
    c = F.translate(compatible(text_of(c)), "‐‑‒–—−‘’‚“”„   ", "------'''\"\"\"   ")
    return strip(F.regexp_replace(spaced(F.lower(c)), " +", " "))


def canonical_filename(c) -> Column:
    return F.lower(F.element_at(F.split(F.replace(text_of(c), F.lit("\\"), F.lit("/")), "/"), -1))


def unaccent(c) -> Column:
    return F.translate(F.lower(text_of(c)), ACCENTED, PLAIN)


def index_terms(c) -> Column:
    """The terms of the full-text index: runs of letters and digits without marks."""
    return F.regexp_extract_all(unaccent(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(c) -> Column:
    """Distinct terms of a question in order, without stop words unless there is nothing else."""
    found = F.regexp_extract_all(F.lower(strip(compatible(text_of(c)))), F.lit(r"([A-Za-z0-9][A-Za-z0-9_-]*)"), F.lit(1))
    kept = F.filter(found, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) >= 2))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(found))


def query_string(c) -> Column:
    return F.array_join(F.transform(query_terms(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def tokens(c) -> Column:
    return F.array_remove(F.split(spaced(text_of(c)), " "), "")


def token_count(c) -> Column:
    """The number of tokens, without making them."""
    return F.regexp_count(spaced(text_of(c)), F.lit("[^ ]+"))


def sentences(c) -> Column:
    """Cut after . ! or ? and white space."""
    cut = F.split(F.regexp_replace(strip(text_of(c)), f"([.!?]){SPACE}+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def paragraphs(c) -> Column:
    """Cut at blank lines; lines of a paragraph are joined by a space."""
    text = F.regexp_replace(text_of(c), r"\r\n|\r", "\n")
    cut = F.split(text, r"\n[ \t\x0b\f]*\n[ \t\x0b\f\n]*")
    return F.filter(F.transform(cut, lambda p: strip(F.regexp_replace(p, f"{SPACE}*\\n{SPACE}*", " "))), lambda p: p != "")


def technology_form(c) -> Column:
    c = F.regexp_replace(spaced(F.lower(text_of(c))), r"[ _\-/\\]+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_ .+#]", "")
    return strip(F.regexp_replace(c, " +", " "))


def detect_format(c) -> Column:
    c = F.lower(text_of(c))
    return F.when(c.endswith(".md"), "markdown").when(c.endswith(".html"), "html").when(c.endswith(".pdf"), "pdf").otherwise("unknown")


def url_filename(c) -> Column:
    """A file name from a URL: its path as a slug, and twelve hexadecimal digits of its checksum."""
    url = text_of(c)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(path), r"[^a-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.concat(F.when(slug == "", "page").otherwise(slug), F.lit("-"), F.substring(F.sha2(url, 256), 1, 12), F.lit(".html"))


def recall_at(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("int"), F.lit(0))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
