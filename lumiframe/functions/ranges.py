"""Parsing of number ranges such as `1,3,5-9:2`, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_ranges(text: Column) -> Column:
    """Numbers of a range string, in order: single numbers, `from-to` also downwards, and `from-to:step`.

    An empty or null string is `0`. Parts that aren't ranges are left out.
    """
    whole = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("0")).otherwise(text)
    pattern = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*(?::\s*(\d+)\s*)?)?$"

    def part(p: Column) -> Column:
        a = F.regexp_extract(p, pattern, 1)
        b = F.regexp_extract(p, pattern, 2)
        s = F.regexp_extract(p, pattern, 3)
        first = F.when(a != "", a).cast("long")
        last = F.when(b != "", b).otherwise(F.when(a != "", a)).cast("long")
        step = F.greatest(F.coalesce(F.when(s != "", s).cast("long"), F.lit(1)), F.lit(1))
        return F.when(first.isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(first, last, F.when(first <= last, step).otherwise(-step)))

    return F.flatten(F.transform(F.split(whole, ","), part))
