"""Cleaning of parsed documents: cleaners rewrite tables of sections (one row a section, as sources.html.sections makes
them), a pipeline runs them by name and reports what went, and a service keeps documents that fail apart.

A row has an id, position, heading, level, heading_path, paragraphs, lists, tables, code and links.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from lexigrove.functions import text as X
from lexigrove.operators import parts
from lexigrove.sources.shared import kept, small_batches

Cleaner = Callable[[DataFrame, str], DataFrame]
#: Fixed value: the order in which the default pipeline cleans.
DEFAULT = ("unicode", "whitespace", "boilerplate", "duplicate")
_CLEANERS: dict[str, Cleaner] = {}
_ROWS = 200  # sections that are held as Python objects at once


def normal_name(name: str) -> str:
    """A cleaner's name as it is looked up: lower case, words joined by underscores, without a last `cleaner`."""
    out = "_".join(name.strip().lower().replace("-", " ").replace("_", " ").split())
    out = out.removesuffix("_cleaner")
    if not out:
        raise ValueError("a cleaner needs a name")
    return out


def register(*names: str) -> Callable[[Cleaner], Cleaner]:
    """Makes a cleaner known under names of its own; a name that is taken fails."""

    def keep(cleaner: Cleaner) -> Cleaner:
        for name in map(normal_name, names):
            if name in _CLEANERS:
                raise ValueError(f"cleaner {name} is there already")
            _CLEANERS[name] = cleaner
        return cleaner

    return keep


def items(lists: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(lists, lambda one: F.transform(one, fn))


def filled(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def has_content(prefix: str = "") -> Column:
    """Paragraphs, list items, tables or code: a heading or links alone are none."""
    return F.size(F.concat(*[F.transform(f"{prefix}{c}", lambda x: F.lit(1)) for c in ("paragraphs", "lists", "tables", "code")])) > 0


def is_empty() -> Column:
    return ~has_content() & (X.strip(X.text_of("heading")) == "")


def _positions(sections: DataFrame, id_col: str) -> DataFrame:
    """Positions from 0 anew."""
    return sections.withColumn("position", F.row_number().over(Window.partitionBy(id_col).orderBy("position")) - 1)


class Function:
    """A cleaner that is a Python function of a section's row. What it raises is kept with the row: the document failed."""

    def __init__(self, name: str, fn: Callable[[dict], dict]):
        self.name, self.fn = name, fn

    def told(self, sections: DataFrame) -> DataFrame:
        """sections with `error`, null where the function did its work; a row with an error is as it was."""
        shape = StructType([*sections.schema.fields]).add("error", StringType())
        to = to_arrow_schema(shape)
        name, fn = self.name, self.fn
        small_batches(sections.sparkSession)

        def row_of(held: pa.RecordBatch, i: int) -> dict:
            return held.slice(i, 1).to_pylist()[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    held, out = batch.slice(at, _ROWS), []
                    for i, row in enumerate(held.to_pylist()):
                        try:
                            made = fn(row) | {"error": None}
                        except Exception as e:  # any document may break any cleaner, and the others go on
                            made = row_of(held, i) | {"error": f"{name}: {type(e).__name__}: {e}"}
                        out.append(made)
                    try:
                        told = pa.RecordBatch.from_pylist(out, schema=to)
                    except Exception:  # a row of another form is an error of this row alone
                        for i, made in enumerate(out):
                            try:
                                pa.RecordBatch.from_pylist([made], schema=to)
                            except Exception as e:
                                out[i] = row_of(held, i) | {"error": f"{name}: {type(e).__name__}: {e}"}
                        told = pa.RecordBatch.from_pylist(out, schema=to)
                    yield told

        return sections.mapInArrow(run, shape)

    def __call__(self, sections: DataFrame, id_col: str) -> DataFrame:
        """The pipeline's way: the first error fails the job."""
        done = self.told(sections)
        failed = F.raise_error(F.concat(F.lit("document "), F.col(id_col).cast("string"), F.lit(": "), F.col("error")))
        return done.withColumn("position", F.when(F.col("error").isNull(), F.col("position")).otherwise(failed.cast(sections.schema["position"].dataType))).drop("error")


def register_function(*names: str) -> Callable[[Callable[[dict], dict]], Callable[[dict], dict]]:
    """Like `register`, for a function of one section's row."""

    def keep(fn: Callable[[dict], dict]) -> Callable[[dict], dict]:
        register(*names)(Function(normal_name(names[0]), fn))
        return fn

    return keep


def unregister(name: str) -> None:
    _CLEANERS.pop(normal_name(name), None)


def fold(text: str, keep: str = "\n\r") -> str:
    """Compatibility folding, the fixed replacements, and no control characters but those to keep."""
    text = unicodedata.normalize("NFKC", text).translate({ord(c): to for chars, to in X.REPLACED for c in chars})
    return text if text.isprintable() else "".join(c for c in text if c in keep or unicodedata.category(c)[0] != "C")


@register_function("unicode", "unicode normalizer")
def clean_unicode(row: dict) -> dict:
    """Compatibility folding and the fixed replacements in all texts; code keeps tabs and its own line ends, without
    blanks at their end."""

    def code(text: str) -> str:
        lines = [x.rstrip() for x in fold(text.replace("\r\n", "\n").replace("\r", "\n"), "\n\t").split("\n")]
        first = next((i for i, x in enumerate(lines) if x), len(lines))
        return "\n".join(lines[first:]).rstrip()

    def every(value):
        if isinstance(value, str):
            return fold(value).strip()
        if isinstance(value, list):
            return [every(x) for x in value]
        return {k: every(x) for k, x in value.items()} if isinstance(value, dict) else value

    for c in ("heading", "heading_path", "paragraphs", "lists", "tables", "links"):
        row[c] = every(row[c])
    row["code"] = [x | {"content": code(x["content"] or "")} for x in row["code"]]
    return row


@register("whitespace", "whitespace normalizer")
def clean_whitespace(sections: DataFrame, id_col: str) -> DataFrame:
    """Blanks unified in all texts, indentation kept in code; what is empty then goes."""
    line = X.clean_inline
    rows = F.transform("tables", lambda t: F.struct(F.transform(t["headers"], line).alias("headers"), F.transform(t["rows"], lambda r: F.transform(r, line)).alias("rows")))
    code = F.transform("code", lambda c: F.struct(X.clean_code(c["content"]).alias("content"), F.nullif(line(c["language"]), F.lit("")).alias("language")))
    return sections.withColumns(
        {
            "heading": F.nullif(line(F.col("heading")), F.lit("")), "heading_path": F.transform("heading_path", line), "paragraphs": filled(F.transform("paragraphs", X.clean_multiline)),
            "lists": F.filter(F.transform("lists", lambda one: filled(F.transform(one, line))), lambda one: F.size(one) > 0), "tables": rows,
            "code": F.filter(code, lambda c: c["content"] != ""), "links": F.transform("links", lambda a: F.struct(line(a["text"]).alias("text"), X.strip(a["url"]).alias("url"))),
        }
    )


def boilerplate_cleaner(lines: tuple[str, ...] = (), patterns: tuple[str, ...] = (), urls: tuple[str, ...] = ()) -> Cleaner:
    """A cleaner of navigation: the fixed lines, patterns and parts of addresses, and further ones of the caller."""
    wrong = lambda c: X.is_boilerplate(c, lines, patterns)

    def run(sections: DataFrame, id_col: str) -> DataFrame:
        kept = sections.where(~wrong("heading")).withColumns(
            {
                "paragraphs": F.filter("paragraphs", lambda p: ~wrong(p)), "lists": F.filter(F.transform("lists", lambda one: F.filter(one, lambda x: ~wrong(x))), lambda one: F.size(one) > 0),
                "links": F.filter("links", lambda a: ~(wrong(a["text"]) | X.is_boilerplate_url(a["url"], urls))),
            }
        )
        return _positions(kept.where(~is_empty()), id_col)

    return run


@register("boilerplate")
def clean_boilerplate(sections: DataFrame, id_col: str) -> DataFrame:
    """Navigation goes: a section under such a heading as a whole, elsewhere paragraphs, items and links. Tables and code
    stay. Sections left empty go."""
    return boilerplate_cleaner()(sections, id_col)


def first_of(c: Column, form: Callable[[Column], Column]) -> Column:
    """The first of the elements with one form; those with an empty form all stay. Elements are sorted by form once, so
    the time is nearly in proportion to their number."""
    marked = F.sort_array(F.transform(c, lambda x, i: F.struct(form(x).alias("form"), i.alias("i"))))
    fresh = lambda s: F.filter(s, lambda x, k: (x["form"] == "") | (k == 0) | (F.get(s, k - 1)["form"] != x["form"]))
    return X.once(marked, lambda s: F.transform(F.sort_array(F.transform(fresh(s), lambda x: x["i"])), lambda i: F.get(c, i)))


@register("duplicate", "duplicates", "dedup")
def clean_duplicates(sections: DataFrame, id_col: str) -> DataFrame:
    """The first of equal paragraphs, items, table rows, code blocks and links of a section, and of equal sections of a
    document, whatever their case and spacing; sections without content go."""
    form = X.dedup_form
    row_form = lambda r: F.array_join(F.transform(r, form), "␟")
    rows = F.transform("tables", lambda t: F.struct(t["headers"].alias("headers"), first_of(t["rows"], row_form).alias("rows")))
    out = sections.withColumns(
        {
            "paragraphs": first_of(F.col("paragraphs"), form), "lists": F.transform("lists", lambda one: first_of(one, form)), "tables": rows,
            "code": first_of(F.col("code"), lambda c: c["content"]), "links": first_of(F.col("links"), lambda a: F.concat_ws("␟", form(a["text"]), a["url"])),
        }
    )
    print_of = F.sha2(F.to_json(F.struct(form("heading").alias("h"), F.transform("paragraphs", form).alias("p"), items(F.col("lists"), form).alias("l"), "tables", "code")), 256)
    nth = F.row_number().over(Window.partitionBy(id_col, "fingerprint").orderBy("position"))
    once = out.where(has_content()).withColumn("fingerprint", print_of).withColumn("nth", nth).where("nth = 1")
    return _positions(once.drop("fingerprint", "nth"), id_col)


@register("document duplicates")
def clean_document_duplicates(sections: DataFrame, id_col: str) -> DataFrame:
    """The first of equal parts of a whole document, then as `duplicate`."""
    return clean_duplicates(parts.drop_repeated_parts(sections, id_col, "document").drop("removed"), id_col)


def counts(sections: DataFrame, *by: str) -> DataFrame:
    """Sections and their parts."""
    each = {
        "paragraphs": F.size("paragraphs"), "list_items": F.aggregate("lists", F.lit(0), lambda s, x: s + F.size(x)), "table_rows": F.aggregate("tables", F.lit(0), lambda s, t: s + F.size(t["rows"])),
        "code_blocks": F.size("code"), "links": F.size("links"),
    }
    return sections.groupBy(*by).agg(F.count("*").alias("sections"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in each.items()])


def cleaner(name: str) -> Cleaner:
    if normal_name(name) not in _CLEANERS:
        raise ValueError(f"no cleaner {name}; there are {', '.join(sorted(_CLEANERS))}")
    return _CLEANERS[normal_name(name)]


def clean(sections: DataFrame, id_col: str, cleaners: tuple[str, ...] = DEFAULT) -> DataFrame:
    """The cleaners' work one after the other; the input is a table and stays as it is. A document that breaks a cleaner
    fails the job: see `clean_service`."""
    for name in cleaners:
        sections = cleaner(name)(sections, id_col)
    return sections


class CleaningError(ValueError):
    """A document broke a cleaner, and the service was to stop."""


@dataclass
class Cleaned:
    """What the service made: sections of the documents that came through, a row for each document (id, document, error and
    what was removed, document being null where it failed), and counts over all."""

    sections: DataFrame
    results: DataFrame
    totals: dict[str, int]


def clean_service(sections: DataFrame, id_col: str, cleaners: tuple[str, ...] = DEFAULT, stop_on_error: bool = False) -> Cleaned:
    """The cleaners over a batch of documents, each for itself: one that breaks a cleaner is reported with the cleaner's
    name and the error, and takes no part from there on, and the others are cleaned. With stop_on_error, the document
    of the smallest id that failed at a cleaner fails the batch, and no later cleaner runs.

    Results after each Python cleaner are written to the shared folder, so that it runs once. The totals are observed in
    the jobs that write first and last. A batch without sections fails.
    """
    seen, left = Observation(), Observation()
    every = sections.observe(seen, F.count(F.lit(1)).alias("input_sections"), F.count_if(F.col("position") == 0).alias("total_documents"))
    first = now = kept(every, "clean-input")
    if not seen.get["input_sections"]:
        raise CleaningError("there are no documents to clean")
    broken: list[DataFrame] = []
    for name in cleaners:
        one = cleaner(name)
        if not isinstance(one, Function):
            now = one(now, id_col)
            continue
        told = kept(one.told(now), "clean-step")
        failed = told.where("error is not null").groupBy(id_col).agg(F.min_by("error", "position").alias("error"))
        if stop_on_error and (worst := failed.orderBy(id_col).first()):
            raise CleaningError(f"document {worst[id_col]}: {worst['error']}")
        broken.append(failed)
        now = told.drop("error").join(failed, id_col, "left_anti")
    none = sections.sparkSession.createDataFrame([], StructType([sections.schema[id_col], StructField("error", StringType())]))
    errors = kept(reduce(DataFrame.unionByName, broken, none), "clean-errors")
    done = kept(now.observe(left, F.count(F.lit(1)).alias("output_sections")), "clean-output")
    told = report(first, done, id_col).drop("success").join(errors, id_col, "left")
    document = F.when(F.col("error").isNull(), F.struct("output_sections", *[c for c in told.columns if c.startswith("removed_")]))
    results = told.select(id_col, F.col("error").isNull().alias("ok"), document.alias("document"), "error", "input_sections")
    failed_documents = errors.count()
    totals = seen.get | left.get | {"failed_documents": failed_documents}
    return Cleaned(done, results, totals | {"successful_documents": totals["total_documents"] - failed_documents})


def report(before: DataFrame, after: DataFrame, id_col: str) -> DataFrame:
    """What cleaning removed from each document; success is that something is left."""
    parts = ("sections", "paragraphs", "list_items", "table_rows", "code_blocks", "links")
    left = counts(after, id_col).select(id_col, *[F.col(p).alias(f"left_{p}") for p in parts])
    both = counts(before, id_col).join(left, id_col, "left")
    rest = lambda p: F.coalesce(F.col(f"left_{p}"), F.lit(0))
    return both.select(id_col, F.col("sections").alias("input_sections"), rest("sections").alias("output_sections"), *[(F.col(p) - rest(p)).alias(f"removed_{p}") for p in parts], (rest("sections") > 0).alias("success"))
