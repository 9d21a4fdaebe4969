"""Metadata of any shape as VARIANT: nested records and lists, whose strings are cleaned wherever they stand."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A string of JSON, and what follows if it is a key.
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"(\s*:)?')


def each_string(clean: Callable[[str], str], keys: bool = False) -> Callable[[Column], Column]:
    """A function of VARIANT columns that cleans every string value, at any depth; with keys, names too. Numbers, booleans and
    nulls stay as they are. Records whose names become equal by cleaning fail."""

    @F.pandas_udf(StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(m: re.Match) -> str:
            if m[1] and not keys:
                return m[0]
            return json.dumps(clean(json.loads(m[0][: len(m[0]) - len(m[1] or "")])), ensure_ascii=False) + (m[1] or "")

        for batch in texts:
            yield batch.map(lambda t: None if t is None else _STRING.sub(one, t))

    return lambda c: F.parse_json(run(F.to_json(c)))


def single_spaced(text: str) -> str:
    """White space as single blanks, none at the ends."""
    return " ".join(text.split())


def filled(c: Column, path: str, kind: str = "string") -> Column:
    """A value of a VARIANT by path, null where there is none or it is an empty text."""
    return F.nullif(F.try_variant_get(c, path, kind), F.lit("").cast(kind)) if kind == "string" else F.try_variant_get(c, path, kind)
