"""Two-level text comparison: lines first, then the tokens of the lines that changed.

Both levels follow a longest common subsequence, from the start of both texts: equal items are paired at once, else an item is
removed if what follows has as long a common subsequence without it, else one is added. Lengths of subsequences of all suffixes decide that; only every
k-th row of their table is kept, for k near the root of the number of items, and the rows between are made again on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_TOKENS = re.compile(r"\s+|[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")
# Marks of lists, which count as formatting.
_BULLET = re.compile(r"^\s*([-•*]+|\d+[.)]|[a-zA-Z][.)])\s*")


def _row_above(item: int, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Lengths for the suffixes that begin with one more ``item``, from those below."""
    row = np.where(b == item, below[1:] + 1, below[:-1])
    return np.append(np.maximum.accumulate(row[::-1])[::-1], 0).astype(np.int32)


def script(a: list, b: list) -> list[str]:
    """The steps from ``a`` to ``b``: '=' for a pair, '-' for an item of ``a``, '+' for one of ``b``."""
    number: dict = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in items], np.int64) for items in (a, b))
    n, m = len(x), len(y)
    step = isqrt(n) + 1
    row, held = np.zeros(m + 1, np.int32), {n: np.zeros(m + 1, np.int32)}
    for i in range(n - 1, -1, -1):
        row = _row_above(x[i], y, row)
        if i % step == 0:
            held[i] = row
    out, i, j = [], 0, 0
    while i < n and j < m:
        start, end = i // step * step, min(n, (i // step + 1) * step)
        rows = {end: held[end]}
        for k in range(end - 1, start - 1, -1):
            rows[k] = _row_above(x[k], y, rows[k + 1])
        while i < end and j < m:
            if x[i] == y[j]:
                out.append("=")
                i, j = i + 1, j + 1
            elif rows[i + 1][j] >= rows[i][j + 1]:
                out.append("-")
                i += 1
            else:
                out.append("+")
                j += 1
    return out + ["-"] * (n - i) + ["+"] * (m - j)


def _split(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def plain(text: str) -> str:
    """A text without its formatting: bullets, indents and blank lines go, lines are joined by spaces."""
    lines = (_BULLET.sub("", line).strip() for line in _split(text))
    return " ".join(line for line in lines if line)


def tokens(text: str, strict: bool) -> list[str]:
    """Characters if ``strict``, else runs of white space, words and single signs."""
    return list(text) if strict else _TOKENS.findall(text)


def _runs(parts: list[tuple[str, bool]]) -> list[dict]:
    return [{"text": "".join(t for t, _ in run), "changed": changed} for changed, run in groupby(parts, lambda p: p[1])]


def _changed(a: str, b: str, strict: bool, fold: bool) -> tuple[list[dict], list[dict]]:
    x, y = tokens(a, strict), tokens(b, strict)
    key = str.lower if fold else str
    left, right, i, j = [], [], 0, 0
    for op in script([key(t) for t in x], [key(t) for t in y]):
        if op != "+":
            left.append((x[i], op == "-"))
            i += 1
        if op != "-":
            right.append((y[j], op == "+"))
            j += 1
    return _runs(left), _runs(right)


def compare(reference: str, compared: str, strict: bool = False, ignore_format: bool = False) -> list[tuple]:
    """(reference line or None, compared line or None, changed, its parts, the other's parts), lines from 1.

    Lines removed and added between two equal ones are paired in order. ``ignore_format`` compares the plain texts in any case.
    """
    if ignore_format:
        reference, compared = plain(reference), plain(compared)
    a, b, out, i, j = _split(reference), _split(compared), [], 0, 0
    key = str.lower if ignore_format else str
    for same, run in groupby(script([key(t) for t in a], [key(t) for t in b]), lambda op: op == "="):
        ops = list(run)
        if same:
            for _ in ops:
                part = [{"text": a[i], "changed": False}]
                i, j = i + 1, j + 1
                out.append((i, j, False, part, part))
            continue
        gone, new = ops.count("-"), ops.count("+")
        for k in range(max(gone, new)):
            left, right = _changed(a[i + k] if k < gone else "", b[j + k] if k < new else "", strict, ignore_format)
            out.append((i + k + 1 if k < gone else None, j + k + 1 if k < new else None, True, left, right))
        i, j = i + gone, j + new
    return out


_PARTS = "array<struct<text: string, changed: boolean>>"


def line_diff(rows: DataFrame, id_col: str, strict: bool = False, ignore_format: bool = False) -> DataFrame:
    """Rows (id, reference, compared) to a row for each pair of lines. Null texts are empty, and an empty text is one empty line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, *d) for i, a, b in zip(batch[id_col], batch["reference"], batch["compared"], strict=True) for d in compare(a or "", b or "", strict, ignore_format)]
            out = pd.DataFrame(found, columns=[id_col, "ref_line", "cmp_line", "changed", "ref_parts", "cmp_parts"])
            yield out.astype({"ref_line": "Int64", "cmp_line": "Int64"})

    return rows.select(id_col, "reference", "compared").mapInPandas(run, f"{id_col} bigint, ref_line bigint, cmp_line bigint, changed boolean, ref_parts {_PARTS}, cmp_parts {_PARTS}")


def summary(rows: DataFrame, id_col: str, strict: bool = False, ignore_format: bool = False) -> DataFrame:
    """(id, exact, status, detail, changed_lines) of rows (id, reference, compared)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for i, a, b in zip(batch[id_col], batch["reference"], batch["compared"], strict=True):
                a, b = a or "", b or ""
                changed = sum(d[2] for d in compare(a, b, strict, ignore_format))
                exact = plain(a).lower() == plain(b).lower() if ignore_format else a == b
                same = "Match when formatting ignored." if ignore_format else "Texts are identical."
                found.append((i, exact, "Exact Match" if exact else "Differences Found", same if exact else f"{changed} differing line{'s' * (changed != 1)}.", changed))
            yield pd.DataFrame(found, columns=[id_col, "exact", "status", "detail", "changed_lines"])

    return rows.select(id_col, "reference", "compared").mapInPandas(run, f"{id_col} bigint, exact boolean, status string, detail string, changed_lines bigint")
