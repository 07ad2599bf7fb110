"""From raw documents to packed sequences: toxicity, quality rules, near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import materialize, read_table
from ledgerloom.llm.ngram_join import keep_one_of_each_group
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import drop_low_quality
from ledgerloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of operator 8, which learns from the labels.

    A null or empty text is scored like any other; null and repeated ids are judged each by its text; texts of any length are scored whole; extra columns stay.
    An empty table stays empty.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence of operator 9 keep.

    Null, empty and short texts go; a null language is compared with all rows; null and repeated ids are judged each by its text and language; extra columns
    stay. An empty table stays empty.
    """
    return drop_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of operator 1, over shingles of five words at 0.8.

    Rows without words or without an id stay, as nobody's copies; rows that repeat an id are one document and stay or go together; extra columns stay. An empty
    table stays empty.
    """
    return keep_one_of_each_group(docs, k=5, num=8, den=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 tokens, by operator 3: pieces with their place, no other columns. A null text is empty and has its end token; an empty table has no pieces."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again by the next; the last returns pieces of sequences.

    Null texts score as empty ones and go with the quality rules, as short texts do. Rows that repeat an id are judged each in the first
    two stages and are one document in the third; rows with a null id go through all of them, and none is their copy. Texts of any
    length are read whole. Extra columns are carried to the last stage, whatever their names. Empty tables give no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
