"""Coercion of all-text cells to typed values; what doesn't parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "d-MMM-yyyy", "yyyyMMdd")


def coerce_str(c: Column) -> Column:
    """Stripped; blank, nan and NaT are null; a spreadsheet's ="..." is unwrapped."""
    text = F.trim(F.regexp_replace(F.trim(c.cast("string")), '^="(.*)"$', "$1"))
    return F.when(~text.isin("", "nan", "NaT"), text)


def coerce_num(c: Column) -> Column:
    """A plain number; one with a thousands comma is null."""
    return coerce_str(c).try_cast("double")


def coerce_int(c: Column) -> Column:
    """Truncated toward zero."""
    return coerce_num(c).cast("int")


def coerce_date(c: Column) -> Column:
    text = coerce_str(c)
    return F.to_date(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS)))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*map(coerce_str, columns))
