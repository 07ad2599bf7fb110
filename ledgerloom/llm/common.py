"""Shared plumbing: table access, lineage cuts in the shared folder, Arrow text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session has none and the master is local (tests on one machine) a temporary folder is set; executors on
    other machines wouldn't see it.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches: few rows each, so that very long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: Keys that are joined by a broadcast, the largest; no other key holds more than 1 / HOT_KEYS of all rows.
HOT_KEYS, HOT_ROWS = 10_000, 256


def join_apart(rows: DataFrame, facts: DataFrame, *on: str, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one for each key and with the number ``n`` of its rows.

    The facts of the HOT_KEYS largest keys of over HOT_ROWS rows are broadcast (some hundred kilobytes), so the rows of a hot key
    stay where they are; all the other keys are joined by a shuffle, in which none of them is large.
    """
    hot = facts.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n), *on).limit(HOT_KEYS).toArrow()  # HOT_KEYS rows at most
    if not hot.num_rows:
        return rows.join(facts, list(on))
    hot = rows.sparkSession.createDataFrame(hot, facts.schema).coalesce(1)
    there = F.broadcast(hot.select(*on))
    rest = rows.join(there, list(on), "left_anti").join(facts.join(there, list(on), "left_anti"), list(on))
    return rows.join(F.broadcast(hot), list(on)).unionByName(rest)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), under fixed names; other columns, clashing or not, are left behind."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and len+1 offsets into them."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if n and raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], *texts: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of the columns ``texts`` (``text`` if none is named), or one row."""
    for batch in batches:
        start, held = 0, 0
        sizes = sum(np.diff(text_bytes(batch.column(batch.schema.get_field_index(name)))[1]) for name in texts or ("text",))
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if len(sizes) > start:
            yield batch.slice(start)
