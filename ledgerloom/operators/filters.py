"""Typed filters over a whitelist of columns (all AND-ed)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def predicate(df: DataFrame, field: str, op: str, value: Any = None) -> Column | None:
    """One filter as a column; a blank field gives None. Nulls drop out of every comparison, ``!=`` included."""
    if not field:
        return None
    require_columns(df, [field])
    column = df[field]
    if op == "is_null":
        return column.isNull()
    if op == "not_null":
        return column.isNotNull()
    if op == "contains":
        return column.ilike(f"%{value}%")
    if op == "not_contains":
        return ~column.ilike(f"%{value}%")
    if op == "prefix":
        return column.ilike(f"{value}%")
    if op == "in":
        return column.isin(list(value))
    if op == "between":
        low, high = value
        return column.between(low, high)
    if op in COMPARISONS:
        return COMPARISONS[op](column, F.lit(value).cast(df.schema[field].dataType))
    raise ValueError(f"unknown operator: {op}")


def apply_filters(df: DataFrame, filters: Iterable[tuple]) -> DataFrame:
    found = [p for f in filters if (p := predicate(df, *f)) is not None]
    return df.where(reduce(lambda a, b: a & b, found)) if found else df


def with_related(df: DataFrame, other: DataFrame, on: str | list[str], wanted: bool | None) -> DataFrame:
    """Tri-state: rows with a match, rows without, or all of them."""
    if wanted is None:
        return df
    return df.join(other, on, "left_semi" if wanted else "left_anti")


def not_true(column: Column) -> Column:
    """``IS NOT TRUE``: false or null."""
    return ~column.eqNullSafe(F.lit(True))


def without_notices(doc_type: Column, include: bool = False) -> Column:
    """Documents but for docketing notices, unless asked for; a null type drops out with them."""
    return F.lit(True) if include else doc_type != "docketing_notice"


def like_any(text: str, *columns: Column) -> Column:
    """Whether one of the columns contains the text, in any case; its own wildcards count as characters."""
    escaped = re.sub(r"([\\%_])", r"\\\1", text)
    return reduce(lambda a, b: a | b, (F.coalesce(c.ilike(f"%{escaped}%"), F.lit(False)) for c in columns))


def is_form_query(text: str) -> bool:
    """Whether a query is a form's number, as I-140 or n-400a, and so looked up rather than searched."""
    return re.fullmatch(r"[A-Z]{1,3}-\d{2,5}[A-Z]?", text.strip(), flags=re.IGNORECASE) is not None


def form_lookup(text: str, form_type: Column, *prefixed: Column) -> Column:
    """Rows of that form, or with a column that begins with its number in any case."""
    return reduce(lambda a, b: a | b, (F.coalesce(c.ilike(f"{text}%"), F.lit(False)) for c in prefixed), F.coalesce(form_type == text.upper(), F.lit(False)))


def incremental(df: DataFrame, done: DataFrame, key: str, since: Column | None = None) -> DataFrame:
    """Rows whose key isn't done yet, or only those since a time."""
    fresh = df.join(done.select(key), key, "left_anti")
    return fresh if since is None else fresh.where(since)


def first_by_priority(df: DataFrame, tests: Iterable[Column], *ties: Column) -> DataFrame:
    """The one row that passes the earliest of the tests, then by ``ties``; none if none passes."""
    tests = list(tests)
    rank = F.coalesce(*(F.when(t, i) for i, t in enumerate(tests)))
    return df.where(rank.isNotNull()).orderBy(rank, *ties).limit(1)


def clean_query(text: str | None) -> str:
    """A query with its white space collapsed."""
    return " ".join((text or "").split())


def filters_used(**values: Any) -> dict[str, Any]:
    """The filters that say something: none that are missing, empty or false."""
    return {k: v for k, v in values.items() if v not in (None, "", False)}
