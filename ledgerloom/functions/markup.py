"""Links and article paragraphs of HTML pages, with the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP, _TAKE = frozenset({"nav", "footer", "header", "script", "style"}), frozenset({"p", "li", "h2", "h3", "h4"})


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.parts, self.skip, self.link, self.part = [], [], 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag == "a" and (href := dict(attrs).get("href")):
            self.link = [href, ""]
        if tag in _TAKE:
            self._close()
            self.part = "" if not self.skip else None

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(self.link[1].split())))
            self.link = None
        if tag in _TAKE:
            self._close()

    def handle_data(self, data):
        if self.link:
            self.link[1] += data
        if self.part is not None and not self.skip:
            self.part += data

    def _close(self):
        text = " ".join((self.part or "").split())
        if text and (not self.parts or self.parts[-1] != text):  # what repeats side by side counts once
            self.parts.append(text)
        self.part = None


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._close()
    return page


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(i, n, *link) for i, html in zip(rows["page_id"], rows["html"], strict=True) for n, link in enumerate(_parsed(html).links)]
            yield pd.DataFrame(found, columns=["page_id", "position", "href", "label"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, position int, href string, label string")


def article_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): paragraphs, items and headings outside of the page's chrome."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(lambda h: "\n".join(_parsed(h).parts))

    return pages.select("page_id", text("html").alias("text"))
