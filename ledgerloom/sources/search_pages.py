"""Decision records from search responses: JSON by columns, result pages by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import collapse, decision_date, docket, stable_id
from ..operators.upsert import keep_first

RESPONSE = "value array<struct<parsed_title string, file_path string, issued_date string, document_type string, program_area string, case_type string, `@search.highlights` struct<content array<string>>>>"
_FIELDS = ["case_name", "docket_number", "decision_date", "document_type", "program_area", "case_type", "source_url", "pdf_url", "snippet"]
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
# What marks a result, its snippet and the next page.
_ITEM_TAGS, _ITEM_CLASSES = frozenset({"article", "li"}), frozenset({"views-row", "search-result"})
_SNIPPET_CLASSES = frozenset({"search-result__snippet", "views-field-search-api-excerpt"})
_NEXT_CLASSES = frozenset({"pager__next", "usa-pagination__next"})


def absolute(base: str, href: Column) -> Column:
    root = base.rstrip("/")
    return F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(root + "/"), href))


def _records(df: DataFrame, key: str) -> DataFrame:
    """The first record of each identity within a response."""
    said = F.struct("case_name", "snippet").cast("string")
    url = F.coalesce("source_url", "pdf_url")
    with_id = df.withColumn("stable_id", stable_id(F.col("docket_number"), F.col("document_type"), F.col("decision_date"), url, said))
    return keep_first(with_id, [key, "stable_id"], [F.col("position")]).select(key, "position", *_FIELDS, "stable_id")


def response_records(responses: DataFrame, key: str, body: str, base: str) -> DataFrame:
    """Records of JSON responses (key, body): the name stands before the docket, highlights join, a path is a PDF's or a page's."""
    doc = F.posexplode(F.from_json(F.col(body), RESPONSE).value).alias("position", "doc")
    d = responses.select(key, doc).select(key, "position", "doc.*")
    title = F.coalesce(collapse(F.col("parsed_title")), F.lit(""))
    before = F.rtrim(F.regexp_extract(title, "(?i)^(.*?)\\b\\d{4}-?(?:PER|INA|TLN)-?\\d{3,6}\\b", 1))
    name = F.when(before != "", F.regexp_replace(before, "[ ,:-]+$", "")).otherwise(title)
    url = F.when(F.coalesce("file_path", F.lit("")) != "", absolute(base, F.col("file_path")))
    is_pdf = F.lower("file_path").endswith(".pdf")
    lit = F.col("`@search.highlights`.content")
    return _records(
        d.select(key, "position", name.alias("case_name"), docket(title).alias("docket_number"), decision_date(F.col("issued_date")).alias("decision_date"), "document_type", "program_area", "case_type",
                 F.when(~is_pdf, url).alias("source_url"), F.when(is_pdf, url).alias("pdf_url"), F.when(F.size(lit) > 0, collapse(F.array_join(lit, " … "))).alias("snippet")), key)


class _Results(HTMLParser):
    """Results in page order, each with its first link, first snippet, first link to a PDF and all its words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.items, self.next = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag == "li" and self.open and self.open[-1]["tag"] == "li":
            self.open.pop()
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        node = {"tag": tag, "item": None, "into": [], "next": bool(classes & _NEXT_CLASSES)}
        if tag in _ITEM_TAGS or classes & _ITEM_CLASSES:
            node["item"] = {"title": None, "href": None, "snippet": None, "pdf": None, "words": []}
            self.items.append(node["item"])
        for item in self._inside():
            if tag == "a":
                href = a.get("href") or ""
                if item["title"] is None:
                    item["title"], item["href"] = [], a.get("href")
                    node["into"].append(item["title"])
                if item["pdf"] is None and (href.endswith(".pdf") or ".pdf?" in href):
                    item["pdf"] = href
            if item["snippet"] is None and (tag == "p" or classes & _SNIPPET_CLASSES):
                item["snippet"] = []
                node["into"].append(item["snippet"])
        if tag == "a" and self.next is None and (a.get("rel") == "next" or any(n["next"] for n in self.open)):
            self.next = a.get("href")
        self.open.append(node)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if text := " ".join(data.split()):
            for item in self._inside():
                item["words"].append(text)
            for node in self.open:
                for part in node["into"]:
                    part.append(text)

    def _inside(self) -> list[dict]:
        return [n["item"] for n in self.open if n["item"] is not None]


def _read(html: str | None) -> _Results:
    page = _Results()
    page.feed(html or "")
    page.close()
    return page


def result_records(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """Records of result pages (key, html): a result without a link is none; docket and date may stand anywhere in it."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for k, body in zip(rows["key"], rows["html"], strict=True):
                for n, item in enumerate(x for x in _read(body).items if x["title"] is not None):
                    title, snippet = " ".join(item["title"]), None if item["snippet"] is None else " ".join(item["snippet"])
                    found.append((k, n, title, item["href"], snippet, item["pdf"], " ".join(filter(None, [title, snippet, *item["words"]]))))
            yield pd.DataFrame(found, columns=["key", "position", "case_name", "href", "snippet", "pdf", "said"])

    raw = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, position int, case_name string, href string, snippet string, pdf string, said string")
    none, said = F.lit(None).cast("string"), F.col("said")
    return _records(
        raw.select(F.col("key").alias(key), "position", "case_name", docket(said).alias("docket_number"), decision_date(said).alias("decision_date"), none.alias("document_type"), none.alias("program_area"), none.alias("case_type"),
                   F.when(F.col("href").isNotNull(), absolute(base, F.col("href"))).alias("source_url"), F.when(F.col("pdf").isNotNull(), absolute(base, F.col("pdf"))).alias("pdf_url"), "snippet"), key)


def next_page(html: Column, base: str) -> Column:
    """Where the next page of results is; null on the last."""

    @F.pandas_udf("string")
    def href(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: _read(body).next)

    found = href(html)
    return F.when(found.isNotNull(), absolute(base, found))
