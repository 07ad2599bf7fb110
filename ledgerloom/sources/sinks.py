"""Sinks: upserts that keep a column, CSV with a total row, corpus statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.upsert import keep_first


def upsert_keeping(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column], kept: Sequence[str]) -> DataFrame:
    """Target with each key's last new row in its place, but for columns ``kept``: a value that was there stays, a null is filled.

    The key must be unique in ``target``. Plain ``upsert`` overwrites these columns, with nulls too.
    """
    fresh = keep_first(rows, key, order).select(*key, F.struct(*(c for c in target.columns if c not in key)).alias("__new"))
    old = target.select(*key, F.struct(*(c for c in target.columns if c not in key)).alias("__old"))

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        new, was = F.col("__new")[c], F.col("__old")[c]
        return (F.coalesce(was, new) if c in kept else F.when(F.col("__new").isNull(), was).otherwise(new)).alias(c)

    return old.join(fresh, list(key), "full").select(*map(value, target.columns))


def with_total(df: DataFrame, label_column: str, totals: Mapping[str, str], label: str = "Grand Total") -> DataFrame:
    """Rows, then one of totals ({column: aggregate}); ``is_total`` tells it, and sorts last."""
    aggs = [F.lit(label).alias(c) if c == label_column else (F.expr(f"{totals[c]}(`{c}`)").cast(t) if c in totals else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes]
    total = df.agg(*(a for a, c in zip(aggs, df.columns, strict=True)), F.lit(True).alias("is_total"))
    return df.select(*(F.col(c).cast("string").alias(c) if c == label_column else F.col(c) for c in df.columns), F.lit(False).alias("is_total")).unionByName(total)


def write_csv(df: DataFrame, path: str, order: Sequence[Column], names: Mapping[str, str] | None = None) -> None:
    """Ordered CSV parts with a header, all cells quoted, quotes doubled; ``names`` are the printed headers. Parts in order of their names."""
    out = df.orderBy(*order)
    out.select(*(F.col(c).alias((names or {}).get(c, c)) for c in df.columns)).write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"', nullValue="")


def corpus_statistics(sections: DataFrame, group: str, text: str) -> DataFrame:
    """(group, sections, with_text, words, characters) by map-side sums."""
    words = F.size(F.filter(F.split(F.trim(F.col(text)), "\\s+"), lambda x: x != ""))
    has = F.coalesce(F.length(text), F.lit(0)) > 0
    return sections.groupBy(group).agg(F.count("*").alias("sections"), F.count_if(has).alias("with_text"), F.coalesce(F.sum(F.when(has, words)), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out; overwrites."""
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, text: str, by: str | None = None) -> None:
    """The column ``text`` as lines; ``by`` a column whose values become folders. Rows without a text are left out; overwrites."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("value"), *([by] if by else []))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)
