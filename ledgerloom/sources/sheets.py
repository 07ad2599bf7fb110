"""Sheets of cells as texts that read without the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(cell: Column) -> Column:
    text = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(text.isin("nan", "NaT", "None", "<NA>"), "").otherwise(text)


def _filled(heads: Column) -> Column:
    """Each head, or the last one before it; col0, col1 and so on where there is none."""
    last = lambda i: F.try_element_at(F.filter(F.slice(heads, 1, i + 1), lambda x: x != ""), F.lit(-1))
    return F.transform(heads, lambda _, i: F.coalesce(last(i), F.concat(F.lit("col"), i.cast("string"))))


def sheet_texts(cells: DataFrame, least: int = 3, shortest: int = 50) -> DataFrame:
    """(sheet_id, text) of rows (sheet_id, label, sheet, line, cells): the first row of ``least`` filled cells heads the rows below it.

    Rows above the head are joined by blanks; without a head all rows are joined by bars. Sheets of one row, or of a text shorter than
    ``shortest``, have none. A sheet is gathered in one row, as its text is.
    """
    d = cells.withColumn("cells", F.transform("cells", _plain)).withColumn("full", F.filter("cells", lambda x: x != ""))
    head = F.min(F.when(F.size("full") >= least, F.struct("line", "cells"))).alias("head")
    row = F.sort_array(F.collect_list(F.struct("line", "cells", "full")))
    sheets = d.groupBy("sheet_id").agg(F.first("label").alias("label"), F.first("sheet").alias("sheet"), head, row.alias("rows")).where(F.size("rows") > 1)
    sheets = sheets.withColumn("names", _filled(F.col("head.cells")))
    n, rows = F.col("head.line"), F.filter("rows", lambda r: F.size(r["full"]) > 0)

    def pairs(r: Column) -> Column:
        named = F.transform(F.slice(r["cells"], 1, F.size("names")), lambda v, i: F.when(v != "", F.concat(F.get("names", i), F.lit(": "), v)))
        return F.array_join(named, " | ")  # nulls are left out

    above = F.transform(F.filter(rows, lambda r: r["line"] < n), lambda r: F.array_join(r["full"], " "))
    below = F.filter(F.transform(F.filter(rows, lambda r: r["line"] > n), pairs), lambda x: x != "")
    bars = F.transform(rows, lambda r: F.array_join(r["full"], " | "))
    top = F.array(F.concat(F.lit("Report: "), "label"), F.concat(F.lit("Sheet: "), "sheet"), F.lit(""))
    lines = F.when(n.isNull(), F.concat(top, bars)).otherwise(F.concat(top, above, F.array(F.lit("")), below))
    return sheets.select("sheet_id", F.array_join(lines, "\n").alias("text")).where(F.length(F.trim("text")) >= shortest)
