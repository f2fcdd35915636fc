"""Dates in file names and frontmatter as column expressions.

ISO, then day-first with a four-digit year, then day-first with two digits; of each form
the first occurrence that is a real day counts.  A date starts at the beginning or after
white space or an underscore, and both its separators are the same.
"""

from __future__ import annotations

import contextlib
import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig

# What a date may follow and come before, and the date forms; pattern, groups
# of day, month and year.
BEFORE = r"(?:(?<=^)|(?<=\s)|(?<=_))"
AFTER = r"(?=$|\s|[_\-])"
FORMS = [
    (BEFORE + r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})" + AFTER, 3, 2, 1),
    (BEFORE + r"([0-9]{1,2})([-.])([0-9]{1,2})\2([0-9]{4})" + AFTER, 1, 3, 4),
    (BEFORE + r"([0-9]{1,2})([-.])([0-9]{1,2})\2([0-9]{2})" + AFTER, 1, 3, 4),
]


def _java(pattern: str) -> str:
    """White space beyond ASCII counts, as it does in Python."""
    return pattern.replace(r"\s", r"(?U:\s)")


def _year(digits: Column, pivot: int) -> Column:
    value = digits.cast("int")
    return F.when(F.length(digits) == 4, value).when(value < pivot, value + 2000).otherwise(value + 1900)


def _valid(day: Column, month: Column, year: Column) -> Column:
    made = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return F.when(year >= 1, made.cast("date"))


def find_date(text: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The first valid date of a text, or null."""
    found = []
    for pattern, day, month, year in FORMS:
        groups = [F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(g)) for g in (day, month, year)]
        # As the two-digit form can't end in the middle of a longer year, forms don't mix.
        days = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "dmy")]), lambda z: _valid(z["d"].cast("int"), z["m"].cast("int"), _year(z["y"], config.year_pivot)))
        found.append(F.get(F.filter(days, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*found)


def stem(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def note_date(path: Column, frontmatter: Column, config: EngineConfig = EngineConfig()) -> Column:
    """struct<date, source>: from the file name, then from the date keys in order.

    ``frontmatter`` is map<string, array<string>>; the first value of a list counts.
    """
    out = F.struct(F.lit(None).cast("date").alias("date"), F.lit("").alias("source"))
    for key in reversed(config.date_keys):
        value = F.regexp_replace(F.get(frontmatter[key], F.lit(0)), r"(?U)^\s+|\s+$", "")
        day = find_date(value, config)
        out = F.when(day.isNotNull(), F.struct(day.alias("date"), F.lit(f"frontmatter:{key}").alias("source"))).otherwise(out)
    if config.date_from_filename:
        day = find_date(stem(path), config)
        out = F.when(day.isNotNull(), F.struct(day.alias("date"), F.lit("filename").alias("source"))).otherwise(out)
    return out


def parse_bound(text: str, config: EngineConfig = EngineConfig()) -> datetime.date:
    """A date a caller gives as the bound of a filter, in the same forms."""
    for pattern, day, month, year in FORMS:
        for m in re.finditer(pattern, text.strip()):
            y = int(m[year])
            full = y if len(m[year]) == 4 else y + (2000 if y < config.year_pivot else 1900)
            with contextlib.suppress(ValueError):
                return datetime.date(full, int(m[month]), int(m[day]))
    raise ValueError(f"{text!r} is no date; try 2026-01-31, 31-01-2026 or 31.01.26")
