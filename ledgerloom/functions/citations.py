"""Citations in decision texts: four kinds, first occurrence of each, with a snippet; and their resolution."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a citation of each kind looks like, in order of precedence.
KINDS = (
    ("precedent", re.compile(r"\b(\d{1,2}\s+[Il]&N\s+Dec\.\s+\d{1,4})\b", re.I)),
    ("board", re.compile(r"\b(\d{4}-PER-\d{1,5})\b", re.I)),
    ("appeals", re.compile(r"\b([A-Z]{3}\d{6}_\d{2}[A-Z]\d{4,5})\b")),
    ("matter_of", re.compile(r"Matter\s+o[fJj]\s*\n?\s*([A-Z][A-Za-z0-9'\-.&/, ]+?)(?=,\s*\d{1,2}\s+[Il]&N\s+Dec\.)")),
)
AROUND = 200


def find(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, cited, snippet) in order of kind, then place; of what is cited twice, the first. Only a small or capital L before &N is read as an I."""
    out, seen = [], set()
    for kind, pattern in KINDS:
        for m in pattern.finditer(text or ""):
            cited = m[1]
            if kind == "precedent":
                cited = " ".join(re.sub(r"[lL]&N", "I&N", cited).split())
            elif kind == "matter_of":
                party = cited.strip().rstrip(",.")
                if len(party) < 3:
                    continue
                cited = f"Matter of {party}"
            else:
                cited = cited.upper()
            if cited not in seen:
                seen.add(cited)
                out.append((kind, cited, text[max(0, m.start() - AROUND) : m.end() + AROUND].replace("\n", " ").strip()))
    return out


def citations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(citing_id, citation_type, cited_raw, context_snippet); the scan keeps texts that could hold one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(i, *c) for i, text in zip(rows["citing_id"], rows["text"], strict=True) for c in find(text)]
            yield pd.DataFrame(found, columns=["citing_id", "citation_type", "cited_raw", "context_snippet"])

    likely = F.col(text_col).rlike("(?i)&N|-PER-|[A-Z]{3}\\d{6}_")
    return docs.where(likely).select(F.col(id_col).cast("bigint").alias("citing_id"), F.col(text_col).alias("text")).mapInPandas(run, "citing_id bigint, citation_type string, cited_raw string, context_snippet string")


def cite_key(cited: Column, canonical: bool = False) -> Column:
    """The key by which a citation is looked up: capitals, as it stands; ``canonical``: a docket's number filled to five digits."""
    key = F.upper(cited)
    docket = F.regexp_extract(key, "^(\\d{4}-PER-)(\\d{1,5})$", 1)
    filled = F.concat(docket, F.lpad(F.regexp_extract(key, "^(\\d{4}-PER-)(\\d{1,5})$", 2), 5, "0"))
    return F.when((docket != "") & F.lit(canonical), filled).otherwise(key)


def resolve(found: DataFrame, known: DataFrame, canonical: bool = False) -> DataFrame:
    """``found`` (citing_id, citation_type, cited_raw, ...) with resolved_id, from ``known`` (citation_type, key, id).

    Of keys that ``known`` repeats the greatest id wins. Null where nothing is known; of the kind appeals such rows go, as do those in
    which a text cites itself.
    """
    names = known.groupBy("citation_type", F.upper("key").alias("__key")).agg(F.max("id").alias("resolved_id"))
    out = found.withColumn("__key", cite_key(F.col("cited_raw"), canonical)).join(names, ["citation_type", "__key"], "left").drop("__key")
    return out.where((F.col("citation_type") != "appeals") | (F.col("resolved_id").isNotNull() & (F.col("resolved_id") != F.col("citing_id"))))
