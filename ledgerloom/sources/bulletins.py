"""Priority-date tables of monthly bulletin pages. The parser only finds cells and the headings above them; all else is columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.extract import priority_cell

# Row labels of both categories and column heads, tried whole first, then as parts in this order.
EMPLOYMENT = (
    ("1st", "EB1"), ("1", "EB1"), ("first", "EB1"), ("2nd", "EB2"), ("2", "EB2"), ("second", "EB2"), ("3rd", "EB3"), ("3", "EB3"), ("third", "EB3"),
    ("other workers", "EB3W"), ("3rd other", "EB3W"), ("other", "EB3W"), ("4th", "EB4"), ("4", "EB4"), ("fourth", "EB4"), ("certain religious workers", "EB4R"),
    ("5th", "EB5"), ("5", "EB5"), ("fifth", "EB5"), ("5th unreserved", "EB5U"), ("unreserved", "EB5U"), ("5th reserved", "EB5R"), ("reserved", "EB5R"), ("5th targeted", "EB5T"),
)
FAMILY = (
    ("1st", "F1"), ("1", "F1"), ("f1", "F1"), ("2a", "F2A"), ("2nd a", "F2A"), ("f2a", "F2A"), ("2b", "F2B"), ("2nd b", "F2B"), ("f2b", "F2B"),
    ("3rd", "F3"), ("3", "F3"), ("f3", "F3"), ("4th", "F4"), ("4", "F4"), ("f4", "F4"),
)
COUNTRIES = (
    ("all chargeability areas except those listed", "ALL"), ("all chargeability", "ALL"), ("all areas", "ALL"), ("china", "CHINA"), ("china-mainland born", "CHINA"), ("china (mainland-born)", "CHINA"),
    ("india", "INDIA"), ("mexico", "MEXICO"), ("philippines", "PHILIPPINES"), ("el salvador", "EL_SALVADOR"), ("guatemala", "GUATEMALA"), ("honduras", "HONDURAS"),
)
_KNOWN = ("ALL", "CHINA", "INDIA", "MEXICO", "PHILIPPINES")
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


def _named(raw: Column, names: tuple[tuple[str, str], ...]) -> Column:
    return let(F.regexp_replace(F.btrim(F.trim(F.lower(raw)), F.lit("*")), "(?U)\\s+", " "), lambda key: _name_of(key, names))


def _name_of(key: Column, names: tuple[tuple[str, str], ...]) -> Column:
    tests = [(key == k, v) for k, v in names] + [(key.contains(k), v) for k, v in names]
    out = F.when(*tests[0])
    for test, value in tests[1:]:
        out = out.when(test, value)
    return out


def preference(raw: Column, category: Column) -> Column:
    """EB1 to EB5T for employment, F1 to F4 for family; null for other labels."""
    return F.when(category == "employment", _named(raw, EMPLOYMENT)).otherwise(_named(raw, FAMILY))


def country(raw: Column) -> Column:
    return _named(raw, COUNTRIES)


class _Bulletin(HTMLParser):
    """Headings, paragraphs, divisions and tables in the order they begin, each with its words; tables also with rows of cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        words = None
        if tag == "table" or tag in ("p", "div") or tag in _HEADINGS:
            words = []
            self.blocks.append((tag, words, []))
        elif tag in ("tr", "td", "th"):
            tables = [block for t, _, block in self.open if t == "table"]
            if tag == "tr":
                for block in tables:
                    block[2].append([])
            elif tables and tables[-1][2]:
                words = []
                tables[-1][2][-1].append(words)
        self.open.append((tag, words, self.blocks[-1] if tag == "table" else None))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if text := " ".join(data.split()):
            for _, words, _ in self.open:
                if words is not None:
                    words.append(text)


def _cells(html: str | None) -> Iterator[tuple]:
    """(date type, category, heads, table, row, column, label, value) of all tables that stand below a heading of each kind."""
    page = _Bulletin()
    page.feed(html or "")
    page.close()
    kind = category = None
    for n, (tag, words, rows) in enumerate(page.blocks):
        if tag == "table":
            texts = [[" ".join(c) for c in row] for row in rows]
            if kind and category and texts and len(texts[0]) >= 3:
                for i, row in enumerate(texts[1:], 1):
                    for j, value in enumerate(row[1 : len(texts[0])]):
                        yield kind, category, texts[0], n, i, j, row[0], value
            continue
        text = " ".join(words).lower()
        if len(text) < 4 or (tag not in _HEADINGS and len(text) >= 120):
            continue  # a long paragraph may name a table without standing over it
        if "dates for filing" in text or "date for filing" in text:
            kind = "dates_for_filing"
        elif "final action" in text:
            kind = "final_action"
        if "employment" in text and ("based" in text or "preference" in text):
            category = "employment"
        elif "family" in text and ("sponsored" in text or "preference" in text):
            category = "family"


def bulletin_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, category_type, date_type, preference, chargeability, priority_date, is_current, is_unavailable, raw_value) of bulletin pages.

    Of repeated cells the first with a date stays, else the first. A table needs a head of three cells that begins with no value and names
    a known country. A country that isn't known keeps its head. One hash aggregation; no window.
    """
    type_ = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, *cell) for k, body in zip(rows["key"], rows["html"], strict=True) for cell in _cells(body)]
            yield pd.DataFrame(found, columns=["key", "date_type", "category_type", "heads", "nth", "line", "place", "label", "raw_value"])

    raw = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(
        run, f"key {type_}, date_type string, category_type string, heads array<string>, nth int, line int, place int, label string, raw_value string")
    named = F.transform(F.slice("heads", 2, F.size("heads") - 1), country)
    head = F.get("heads", F.lit(0))
    fit = F.exists(named, lambda c: c.isin(*_KNOWN)) & ~F.trim(F.upper(head)).rlike("^\\d{1,2}[A-Z]{3}\\d{2,4}$|^\\d+[.,]?\\d*$")
    date, current, unavailable = priority_cell(F.col("raw_value"))
    cells = raw.where(fit & (F.col("raw_value") != "")).select(
        F.col("key").alias(key), "category_type", "date_type", preference(F.col("label"), F.col("category_type")).alias("preference"),
        F.coalesce(F.get(named, F.col("place")), F.get("heads", F.col("place") + 1)).alias("chargeability"),
        F.struct(date.alias("priority_date"), current.alias("is_current"), unavailable.alias("is_unavailable"), "raw_value").alias("cell"), F.struct(date.isNull(), "nth", "line", "place").alias("at"),
    )
    keys = [key, "category_type", "date_type", "preference", "chargeability"]
    return cells.where("preference IS NOT NULL").groupBy(*keys).agg(F.min_by("cell", "at").alias("cell")).select(*keys, "cell.*")


def matrix(rows: DataFrame, countries: list[str]) -> DataFrame:
    """One month's rows as preference by country, each cell as it was printed."""
    return rows.groupBy("preference").pivot("chargeability", countries).agg(F.first("raw_value", ignorenulls=True))


def whole_years(days: Column) -> Column:
    return F.floor(days / 365.25).cast("int")
