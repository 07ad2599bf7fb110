"""Chunks of texts for retrieval: bodies near a target length, each led by the end of the one before it.

A body is a run of paragraphs whose lengths sum to the target at most, or a run of sentences of one paragraph that is longer than
the target; the lead doesn't count. Sections carry their heading path on every chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS_PER_TOKEN = 4
# Fixed value: a regulation's section begins with such a line.
SECTION = re.compile(r"(?m)^§\s*\d+\.\d+[\w.]*")


def tokens(text: str) -> int:
    return max(1, len(text) // CHARS_PER_TOKEN)


def lead(text: str, overlap: int) -> str:
    """What the chunk after ``text`` begins with: its end, from a word's start where there is one, and a space."""
    end = text if len(text) <= overlap * CHARS_PER_TOKEN else text[len(text) - overlap * CHARS_PER_TOKEN :]
    space = end.find(" ") if len(end) < len(text) else -1
    return (end[space + 1 :] if space > 0 else end) + " " if overlap else ""


def _runs(parts: Iterable[str], target: int) -> Iterator[str]:
    """Runs of parts whose lengths sum to the target at most, or one longer part, joined by spaces."""
    held, size = [], 0
    for part in parts:
        n = tokens(part)
        if held and size + n > target:
            yield " ".join(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield " ".join(held)


def bodies(text: str, target: int) -> Iterator[str]:
    paragraphs = [p for part in re.split("\n{2,}", text.replace("\r\n", "\n")) if (p := part.strip())]
    short: list[str] = []
    for paragraph in paragraphs:
        if tokens(paragraph) <= target:
            short.append(paragraph)
            continue
        yield from _runs(short, target)
        short = []
        yield from _runs(re.split(r"(?<=[.!?])\s+", paragraph), target)
    yield from _runs(short, target)


def chunk(text: str | None, target: int = 800, overlap: int = 80) -> list[str]:
    """The chunks of a text; none of a null or blank one."""
    out, before = [], None
    for body in bodies(text or "", target):
        out.append((("" if before is None else lead(before, overlap)) + body).strip())
        before = body
    return [c for c in out if c]


def chunk_sections(text: str | None, target: int = 600, overlap: int = 80) -> list[str]:
    """Sections by their headings, whole where they are short enough, else in chunks. What stands before the first heading is a section."""
    text, out = text or "", []
    marks = [m.span() for m in SECTION.finditer(text)]
    edges = [(0, 0), *marks, (len(text), len(text))]
    for (a, b), (end, _) in zip(edges, edges[1:]):
        section = f"{text[a:b]}\n{text[b:end]}".strip()
        if section:
            out += [section] if tokens(section) <= target else chunk(section, target, overlap)
    return out


_CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType()), T.StructField("chunk_tokens", T.IntegerType())]))


def chunks(text: Column, target: int = 800, overlap: int = 80, sections: bool = False) -> Column:
    """array<struct<chunk_index, chunk_text, chunk_tokens>>, Arrow-batched."""

    @F.pandas_udf(_CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        cut = chunk_sections if sections else chunk
        return texts.map(lambda t: [{"chunk_index": i, "chunk_text": c, "chunk_tokens": tokens(c)} for i, c in enumerate(cut(t, target, overlap))])

    return run(text)


def headed(number: Column, title: Column, text: Column) -> tuple[Column, Column]:
    """(label, text under its label) of a section, so that each chunk's first words say where it stands; null for a blank text."""
    label = F.regexp_replace(F.concat(F.lit("§ "), F.coalesce(number, F.lit("")), F.lit(" — "), F.coalesce(title, F.lit(""))), "^[ —]+|[ —]+$", "")
    return label, F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(label, F.lit("\n\n"), text))


def heading_paths(lines: DataFrame, file: str, place: str, level: str, title: str, levels: int = 6) -> DataFrame:
    """``lines`` with ``path``: array of the titles that each line stands under, outermost first.

    A heading has a level from 1; the others have none. A heading of a level ends those of its level and below: a level's title holds while no heading
    of a smaller or equal level has come since. Levels that were left out aren't in the path.
    """
    order = Window.partitionBy(file).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    at = {n: F.max(F.when(F.col(level) == n, F.col(place))).over(order) for n in range(1, levels + 1)}
    held = {n: F.last(F.when(F.col(level) == n, F.col(title)), ignorenulls=True).over(order) for n in range(1, levels + 1)}
    out = lines.withColumns({f"__at{n}": c for n, c in at.items()} | {f"__said{n}": c for n, c in held.items()})
    said = []
    for n in range(1, levels + 1):
        outer = F.greatest(F.lit(None).cast("bigint"), *(F.col(f"__at{m}") for m in range(1, n))) if n > 1 else F.lit(None).cast("bigint")
        said.append(F.when(outer.isNull() | (outer < F.col(f"__at{n}")), F.col(f"__said{n}")))
    path = F.filter(F.array(*said), lambda t: t.isNotNull())
    return out.withColumn("path", path).drop(*(f"__{k}{n}" for k in ("at", "said") for n in range(1, levels + 1)))


def chunk_corpus(docs: DataFrame, corpus: str, id_col: str, text_col: str, label: Column | None = None, date: Column | None = None, carried: dict[str, Column] | None = None, eligible: Column | None = None, since: str | None = None, until: str | None = None, target: int = 800, sections: bool = False) -> DataFrame:
    """A corpus' chunks: corpus, source_id (text), source_label, source_date, ``carried`` columns, chunk_index, chunk_text, chunk_tokens.

    Eligible are rows with a text that isn't empty, and as ``eligible`` says; a window of dates leaves out rows without a date. A label that is
    missing is the corpus and the id. Newest documents come first within each partition's files.
    """
    when = date if date is not None else F.lit(None).cast("date")
    rows = docs.where(F.coalesce(F.col(text_col), F.lit("")) != "")
    rows = rows.where(eligible) if eligible is not None else rows
    rows = reduce(lambda df, c: df.where(c), [c for c, used in ((when >= F.lit(since), since), (when <= F.lit(until), until)) if used], rows)
    source = F.col(id_col).cast("string")
    name = F.coalesce(label, F.concat(F.lit(f"{corpus}-"), source)) if label is not None else F.concat(F.lit(f"{corpus}-"), source)
    kept = rows.select(F.lit(corpus).alias("corpus"), source.alias("source_id"), name.alias("source_label"), when.alias("source_date"), *(c.alias(n) for n, c in (carried or {}).items()), F.explode(chunks(F.col(text_col), target, sections=sections)).alias("c"))
    return kept.select("*", "c.*").drop("c")
