"""Tables that later steps read again: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Only where that is unset and the master is local, a temporary folder is set for it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back: its lineage ends there, and what isn't deterministic in it is settled."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
