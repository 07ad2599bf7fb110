"""Links of web pages by the rules of single sites, and discovery over pages that list further pages.

Pages are rows (url, html). A page is parsed once, in a task, into a light tree; a rule turns it into rows. Discovery is breadth first over
the table of links: a frontier of pages is joined with it, pages met before are left out by an anti join, until none is new.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import safe_name
from .scratch import folder, kept

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Which links and headings count.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SECTION_HREF, PART_HREF = r"/uscode/text/8/\d", r"/uscode/text/8/chapter-12/subchapter-[^/]+/part-"
SHEETS = (".xlsx", ".xls", ".csv", ".zip")
HEADINGS, WRAPPERS = ("summary", "h2", "h3", "h4", "h5", "button", "span"), ("details", "section", "div", "li", "article")


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """The node's elements, in the page's order, without itself."""
        open_ = [iter(self.children)]
        while open_:
            for child in open_[-1]:
                if isinstance(child, Node):
                    yield child
                    open_.append(iter(child.children))
                    break
            else:
                open_.pop()

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        parts, open_ = [], [self]
        while open_:
            node = open_.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                open_ += reversed(node.children)
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "li":  # a new item ends the one before it
            up = self.at
            while up.parent and up.tag not in ("li", "ul", "ol"):
                up = up.parent
            self.at = up.parent if up.tag == "li" else self.at
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up.parent and up.tag != tag:
            up = up.parent
        if up.parent:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def content_root(root: Node) -> Node:
    """The part with id content, else the main part, else the page."""
    found = [n for n in root.walk() if n.tag == "div" and n.attrs.get("id") == "content"] or root.all("main")
    return found[0] if found else root


def bulletins(root: Node, url: str) -> list[tuple]:
    """(url, label, month) of bulletins, each address once."""
    out, seen = [], set()
    for a in root.all("a"):
        href, label = a.attrs.get("href") or "", a.text()
        m = re.search(r"visa-bulletin-for-([a-z]+)-(\d{4})", href.lower())
        if m and m[1] in MONTHS and label and href not in seen:
            seen.add(href)
            out.append((urljoin(url, href) if href.startswith("/") else href, label, f"{m[2]}-{MONTHS.index(m[1]) + 1:02d}-01"))
    return out


def _items(root: Node, url: str, pattern: str) -> list[tuple[str, str]]:
    out = []
    for item in content_root(root).all("li"):
        a = next((n for n in item.all("a") if re.search(pattern, n.attrs.get("href") or "")), None)
        if a:
            href = a.attrs["href"]
            out.append((urljoin(url, href) if href.startswith("/") else href, a.text()))
    return out


def statute_index(root: Node, url: str) -> list[tuple]:
    """(url, label, kind) of an index page: its parts if it lists any, else its sections without their number."""
    parts = _items(root, url, PART_HREF)
    if parts:
        return [(href, label, "part") for href, label in parts]
    return [(href, re.sub(r"^§\s*[\w.]+\.\s*", "", label), "section") for href, label in _items(root, url, SECTION_HREF)]


def precedents(root: Node, url: str) -> list[tuple]:
    """(url, party, citation, volume, year, body) of decisions, each citation once: a line with a citation and a file."""
    main = next(iter(root.all("main") or [n for n in root.walk() if n.tag == "div" and n.attrs.get("id") == "main-content"] or root.all("body")), None)
    out, seen, volume = [], set(), None
    for node in main.all("h2", "p", "li", "div") if main else []:
        text = node.text()
        if m := re.fullmatch(r"(?i)Volume\s+(\d+)", text):
            volume = int(m[1])
            continue
        cited = re.search(r"(?i)(\d+)\s*I&N\s*Dec\.?\s*(\d+)", text)
        hrefs = [h for a in node.all("a") if (h := a.attrs.get("href") or "") and (h.endswith(".pdf") or "/dl?" in h or "/media/" in h)]
        hrefs = [h for h in (urljoin(url, h) if h.startswith("/") else h for h in hrefs) if h.startswith("http")]
        if "I&N Dec" not in text or not cited or not hrefs:
            continue
        citation = f"{int(cited[1])} I&N Dec. {cited[2]}"
        if citation not in seen:
            seen.add(citation)
            bold = [t for b in node.all("strong", "b") if (t := b.text().strip(".,* "))]
            party = bold[0] if bold else text[: cited.start()].strip().strip(".,* ")
            decided = re.search(r"\(([^)]+?)\s+(\d{4})\)", text)
            out.append((hrefs[0], party[:200], citation, volume or int(cited[1]), int(decided[2]) if decided else None, decided[1].strip()[:100] if decided else ""))
    return out


def _in_quarter(text: str, year: tuple[str, ...], quarter: tuple[str, ...]) -> bool:
    return any(y in text.lower() for y in year) and any(q in text.lower() for q in quarter)


def quarter_sheets(year: tuple[str, ...], quarter: tuple[str, ...]) -> Callable[[Node, str], list[tuple]]:
    """The rule for (url, label) of spreadsheets that stand in a part headed by a fiscal year's quarter, or whose surroundings name it."""

    def rule(root: Node, url: str) -> list[tuple]:
        def sheet(a: Node) -> tuple | None:
            full = urljoin(url, a.attrs.get("href") or "")
            return (full, a.text() or urlparse(full).path.rsplit("/", 1)[-1]) if a.attrs.get("href") and any(e in full.lower() for e in SHEETS) else None

        out: dict[str, tuple] = {}
        for part in root.all(*WRAPPERS):
            head = next((n for n in part.walk() if n.tag in HEADINGS), None)
            if head and _in_quarter(head.text(), year, quarter):
                for found in filter(None, map(sheet, part.all("a"))):
                    out.setdefault(found[0], found)
        for a in root.all("a"):
            found, up = sheet(a), a.parent
            while up and up.tag not in WRAPPERS:
                up = up.parent
            if found and (_in_quarter(up.text()[:400] if up else "", year, quarter) or _in_quarter(a.text(), year, quarter)):
                out.setdefault(found[0], found)
        return list(out.values())

    return rule


def by_rule(pages: DataFrame, rule: Callable[[Node, str], list[tuple]], columns: str) -> DataFrame:
    """(page, position, and the rule's ``columns``) of pages (url, html); a null page has no links."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(url, i, *row) for url, html in zip(rows["url"], rows["html"], strict=True) for i, row in enumerate(rule(tree(html), url or ""))]
            yield pd.DataFrame(found, columns=["page", "position", *names]).astype({n: "Int64" for n in names if f"{n} int" in columns})

    return pages.select("url", "html").mapInPandas(run, f"page string, position int, {columns}")


def bulletin_links(pages: DataFrame) -> DataFrame:
    found = by_rule(pages, bulletins, "url string, label string, month string")
    return found.withColumn("month", F.to_date("month"))


def sheet_links(pages: DataFrame, year: tuple[str, ...], quarter: tuple[str, ...]) -> DataFrame:
    """Spreadsheets of a quarter with a file name: the label with the address' ending, or the address' own name where the label says too little."""
    found = by_rule(pages, quarter_sheets(year, quarter), "url string, label string")
    own = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    ending = F.coalesce(F.nullif(F.lower(F.regexp_extract(own, r"(\.\w+)$", 1)), F.lit("")), F.lit(".xlsx"))
    label = F.when((F.length("label") < 5) | F.lower("label").endswith(ending), F.when(F.length("label") < 5, own).otherwise(F.col("label"))).otherwise(F.concat("label", ending))
    return found.withColumn("filename", safe_name(label))


def precedent_links(pages: DataFrame) -> DataFrame:
    return by_rule(pages, precedents, "url string, party string, citation string, volume int, year int, body string")


def statute_sections(pages: DataFrame, start: DataFrame) -> DataFrame:
    """(section, title, url, trail) of every section that the pages of ``start`` (url) list, or the parts that they list, and so on.

    ``trail`` holds the positions of the links that lead there and orders sections as the pages do; a section that is reached twice keeps its
    first trail. A part whose page isn't there, or was met before, leads nowhere. Every level is one join with the links.
    """
    spark = pages.sparkSession
    links = kept(by_rule(pages, statute_index, "url string, label string, kind string"), folder(spark, "links"))
    edge = links.select(F.col("page"), F.col("url"), "label", "kind", "position")
    front = kept(start.select(F.col("url").alias("page")).distinct().withColumn("trail", F.array().cast("array<int>")), folder(spark, "front"))
    seen, found = front.select("page"), None
    while not front.isEmpty():
        reached = kept(front.join(edge, "page").withColumn("trail", F.concat("trail", F.array("position"))), folder(spark, "reached"))
        leaves = reached.where("kind = 'section'").select("url", "label", "trail")
        found = leaves if found is None else found.unionByName(leaves)
        parts = reached.where("kind = 'part'").groupBy(F.col("url").alias("page")).agg(F.min("trail").alias("trail"))
        front = kept(parts.join(seen, "page", "left_anti"), folder(spark, "front"))
        seen = seen.unionByName(front.select("page"))
    if found is None:
        return spark.createDataFrame([], "section string, title string, url string, trail array<int>")
    first = found.groupBy("url").agg(F.min(F.struct("trail", "label")).alias("first"))
    number = F.regexp_extract("url", "([^/]+)/*$", 1)
    return first.select(number.alias("section"), F.col("first.label").alias("title"), "url", F.col("first.trail").alias("trail"))


# Chrome by class, roots by class, notes by id.
CHROME_CLASS, FIELD_CLASS, NOTES_ID = r"toolbox|sidebar|breadcrumb|tabs", r"field-item", r"notes|tab_default_2"


def section_text(root: Node, url: str) -> list[tuple]:
    """(text, notes) of a section's page: paragraphs, items and headings within the content, chrome left out, a blank line between them; what
    repeats side by side, as nested elements do, counts once."""

    def cut(node: Node) -> None:
        node.children = [c for c in node.children if not isinstance(c, Node) or not (c.tag in ("nav", "footer", "header") or re.search(CHROME_CLASS, c.attrs.get("class") or ""))]
        for child in node.children:
            if isinstance(child, Node):
                below.append(child)

    below = [root]
    while below:
        cut(below.pop())
    fields = [n for n in root.walk() if n.tag == "div" and re.search(FIELD_CLASS, n.attrs.get("class") or "")]
    content = next(iter([n for n in root.walk() if n.tag == "div" and n.attrs.get("id") == "content"] or fields or root.all("main")), root)
    parts: list[str] = []
    for node in content.all("p", "li", "h2", "h3", "h4"):
        text = node.text()
        if len(text) > 2 and (not parts or parts[-1] != text):
            parts.append(text)
    notes = next((n for n in root.walk() if n.tag == "div" and re.search(NOTES_ID, n.attrs.get("id") or "")), None)
    return [("\n\n".join(parts), notes.text() if notes else "")]


def section_texts(pages: DataFrame) -> DataFrame:
    """(page, text, notes) of pages of sections."""
    return by_rule(pages, section_text, "text string, notes string").drop("position")
