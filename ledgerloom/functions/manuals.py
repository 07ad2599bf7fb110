"""Policy files: a name's section and subject, and a manual of many pages cut where its volume label changes.

The splitter is a state machine over pages in order, told as sums over windows: a page that carries a label (from its sixth on) belongs
to that label until the next; a cut falls where the label changes and more than three pages have gathered since the cut before.
As a cut hangs on the one before it, stretches of one label are folded in order within their file, as a stream of narrow rows: one pass, a number held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings of volumes and parts, and the first section.
LABEL = r"(?i)(Volume\s+[IVX\d]+[,\s–—-]+(?:Part\s+[A-Z])?)"
SUBJECT = r"Part\s+[A-Z]\s*[–—-]\s*(.+?)(?:\n|$)"
FIRST_SECTION, FIRST_SUBJECT = "Introduction", "Policy Manual Introduction"
LAST_OPENING_PAGE, MOST_KEPT = 5, 3
SECTION_FILE = r"(?i)^(8 FAM [\d.]+)\s+(.+?)\.pdf$"


def policy_name(name: Column) -> Column:
    """struct<section, subject, title> of a policy file's name; other names are titles without section or subject."""
    section = F.nullif(F.regexp_extract(name, SECTION_FILE, 1), F.lit(""))
    words = F.regexp_extract_all(F.nullif(F.regexp_extract(name, SECTION_FILE, 2), F.lit("")), F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    subject = F.array_join(F.transform(words, F.initcap), "")
    return F.struct(section.alias("section"), subject.alias("subject"), F.coalesce(F.concat(section, F.lit(" — "), subject), F.regexp_replace(name, r"\.pdf", "")).alias("title"))


def as_of(text: Column) -> Column:
    """The first date like 1/31/24 or 1/31/2024 of the first 300 characters."""
    said = F.nullif(F.regexp_extract(F.substring(text, 1, 300), r"(\d{1,2}/\d{1,2}/\d{2,4})", 1), F.lit(""))
    year = F.regexp_extract(said, r"(\d+)$", 1)
    full = F.when(F.length(year) == 4, year).when(F.length(year) == 2, F.concat(F.when(year < "69", "20").otherwise("19"), year))
    return F.try_to_timestamp(F.concat(F.regexp_extract(said, r"^(\d+/\d+/)", 1), full), F.lit("M/d/yyyy")).cast("date")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The section of each stretch (file, stretch, n), rows sorted by file and stretch. Nothing is cut before the first label, nor at it."""
    file, held, nth = None, 0, 0
    for batch in batches:
        found = []
        for name, stretch, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != file:
                file, held, nth = name, 0, 0
            if stretch > 1 and held > MOST_KEPT:
                held, nth = 0, nth + 1
            held += n
            found.append(nth)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["file", "stretch", "nth"])


def split_manual(pages: DataFrame, file: str = "file", page: str = "page", text: str = "text") -> DataFrame:
    """Sections of manuals from rows (file, page from 0, text): file, nth, section, subject, first_page, page_count, filename, full_text.

    A null text is an empty page, which counts; the page index of a repeated or missing number is its place in the order of pages. A label's
    subject is what follows its part, else the label. Names that repeat within a file get a number.
    """
    order = Window.partitionBy("file").orderBy("page", "text")
    rows = pages.select(F.col(file).alias("file"), F.col(page).cast("bigint").alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("i", F.row_number().over(order) - 1)
    said = F.nullif(F.regexp_extract(F.substring("text", 1, 300), LABEL, 1), F.lit(""))
    label = F.when(F.col("i") > LAST_OPENING_PAGE, F.regexp_replace(said, r"^\s+|\s+$", ""))
    rows = rows.withColumn("label", label)
    rows = rows.withColumn("subject", F.when(F.col("label").isNotNull(), F.coalesce(F.substring(F.trim(F.nullif(F.regexp_extract(F.substring("text", 1, 400), SUBJECT, 1), F.lit(""))), 1, 120), F.col("label"))))
    # A stretch begins with each label that differs from the one before it.
    by_place = Window.partitionBy("file").orderBy("i")
    before = F.last("label", ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("stretch", F.sum(F.when(F.col("label").isNotNull() & (before.isNull() | (F.col("label") != before)), 1).otherwise(0)).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = rows.groupBy("file", "stretch").agg(F.count("*").alias("n"))
    stretches = stretches.where("file IS NOT NULL").repartition("file").sortWithinPartitions("file", "stretch")
    sections = stretches.mapInArrow(_folded, f"file {dict(rows.dtypes)['file']}, stretch bigint, nth int")
    rows = rows.join(sections, ["file", "stretch"])
    parts = rows.groupBy("file", "nth").agg(
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("i"))).alias("section"),
        F.max_by("subject", F.when(F.col("label").isNotNull(), F.col("i"))).alias("subject"),
        F.min("page").alias("first_page"), F.count("*").alias("page_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda p: p["text"]), "\n\n").alias("full_text"),
    )
    parts = parts.withColumns({"section": F.coalesce("section", F.lit(FIRST_SECTION)), "subject": F.coalesce("subject", F.lit(FIRST_SUBJECT))})
    stem = F.concat(F.lit("USCIS_PM_"), F.substring(F.translate(F.col("section"), " /,", "__"), 1, 60))
    parts = parts.withColumn("stem", stem).withColumn("again", F.row_number().over(Window.partitionBy("file", "stem").orderBy("nth")) - 1)
    name = F.concat("stem", F.when(F.col("again") > 0, F.concat(F.lit("_"), F.col("again").cast("string"))).otherwise(""), F.lit(".txt"))
    return parts.select("file", "nth", "section", "subject", "first_page", "page_count", name.alias("filename"), "full_text")
