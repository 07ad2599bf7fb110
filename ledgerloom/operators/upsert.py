"""Keep-first, keep-last and partial upserts, and snapshot selection, as windows over a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= keep).drop("__nth")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. ``order`` should end in a unique column, so that the choice is fixed."""
    return _ranked(df, key, order, n)


def insert_ignore(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Target, and of the new rows the first of each key that it lacks."""
    return target.unionByName(keep_first(rows, key, order).join(target.select(*key), list(key), "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Target with each key's last new row in its place. ``order`` lists the latest first."""
    fresh = keep_first(rows, key, order)
    return target.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)


def partial_upsert(df: DataFrame, key: Sequence[str], seq: Sequence[str], first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """Per key: columns ``first`` of its first row and ``last`` of its last one, nulls included. One hash aggregation, no sort."""
    at = F.struct(*seq)
    return df.groupBy(*key).agg(*(F.min_by(c, at).alias(c) for c in first), *(F.max_by(c, at).alias(c) for c in last))


def best_snapshot(files: DataFrame) -> DataFrame:
    """Of files (fiscal_year, quarter, path) the latest quarter of each year; equal quarters: the first path."""
    return keep_first(files, ["fiscal_year"], [F.desc("quarter"), F.col("path")])
