"""Column expressions used all over."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: What stands for no value.
BLANK = ("", "nan", "none", "na", "n/a", "null", "missing", "not applicable", "unknown", "--")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double, NULL for NaN, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0))


def is_blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.lower(F.trim(c)).isin(*BLANK)


def bh(p: Column, *keys: str) -> Column:
    """Benjamini-Hochberg within ``keys``: p * m / rank, then the least over all larger p, at most 1; NULL stays NULL."""
    m = F.count(p).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(p.asc_nulls_last()))
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p * m / rank))


def subject_and_time(name: Column) -> tuple[Column, Column]:
    """``q1_x`` as x and q1, else a name split at its last underscore; NULL both without one."""
    early, split = r"^(q[12])_(.+)$", r"^(.*)_([^_]*)$"
    of = lambda first, second: F.when(name.rlike(early), F.regexp_extract(name, early, first)).when(name.rlike(split), F.regexp_extract(name, split, second))
    return of(2, 1), of(1, 2)


def arm_of(title: Column) -> Column:
    """A sample's title without the number of its replicate."""
    return F.btrim(F.regexp_replace(F.trim(title), r"(?i)[\s_-]*(?:rep(?:licate)?[\s_-]*)?\d+$", ""), F.lit(" _-"))


def sex_label(c: Column) -> Column:
    """female, male or NULL; female is tested first because it holds 'male'."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("f", "female", "woman", "women") | low.startswith("female"), "female").when(low.isin("m", "male", "man", "men") | low.startswith("male"), "male")


def value_and_unit(c: Column) -> tuple[Column, Column]:
    """'8 weeks' as 8 and weeks; text without a leading number is the value."""
    text = F.trim(c)
    pattern = r"^(\d+(?:\.\d+)?)\s*([A-Za-z].*)?$"
    hit = text.rlike(pattern)
    value = F.when(is_blank(c), None).when(hit, F.regexp_extract(text, pattern, 1)).otherwise(text)
    unit = F.when(~is_blank(c) & hit, F.nullif(F.trim(F.regexp_extract(text, pattern, 2)), F.lit("")))
    return value, unit
