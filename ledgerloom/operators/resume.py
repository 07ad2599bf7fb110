"""Batches that may be broken off and run again: a keyed merge with a status table.

A target is a folder of batch folders. A batch is written whole or not at all, its status row after it; what a broken batch
has left without a status is never read. So a second run does what the first one left, and two runs that broke off give the rows of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STATUS = "batch int, rows bigint"


class Target:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def status(self) -> DataFrame:
        """(batch, rows) of the batches that were finished."""
        path = f"{self.path}/status"
        return self.spark.read.schema(_STATUS).parquet(path) if self._there(path) else self.spark.createDataFrame([], _STATUS)

    def rows(self) -> DataFrame:
        """The rows of all finished batches; of a key that several hold the last batch's."""
        if not self._there(f"{self.path}/status"):
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(f"{self.schema}, attempt string, batch int").parquet(f"{self.path}/batches")
        done = self.spark.read.schema(f"{_STATUS}, attempt string").parquet(f"{self.path}/status")
        rows = stored.join(F.broadcast(done.select("batch", "attempt")), ["batch", "attempt"], "left_semi")  # one row for each batch
        nth = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("batch")))
        return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth", "batch", "attempt")

    def write(self, batch: int, rows: DataFrame, attempt: str) -> None:
        """Write a batch, then its status. The same attempt's leavings are replaced."""
        path = f"{self.path}/batches/attempt={attempt}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        n = self.spark.read.schema(self.schema).parquet(path).count()
        self.spark.createDataFrame([(batch, n, attempt)], f"{_STATUS}, attempt string").coalesce(1).write.mode("append").parquet(f"{self.path}/status")


def merge(target: Target, source: DataFrame, batch_of: str, make: Callable[[DataFrame], DataFrame], attempt: str, batches: list[int] | None = None) -> int:
    """Make and write the rows of ``source`` whose key the target lacks, batch by batch; returns the number of batches written.

    ``batch_of`` is the column with a row's batch. A batch that ``make`` fails on is raised and leaves all earlier ones finished.
    """
    todo = source.join(target.rows().select(target.key), target.key, "left_anti")
    order = sorted(r[0] for r in todo.select(batch_of).distinct().collect()) if batches is None else batches  # batch numbers
    first = max((r.batch for r in target.status().select("batch").collect()), default=-1) + 1
    for n, value in enumerate(order):
        target.write(first + n, make(todo.where(F.col(batch_of) == value)), attempt)
    return len(order)


def merged_crawl(fetched: DataFrame, prior: DataFrame, groups: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """A crawl's rows together with those of an earlier one, in the canonical order of ``groups`` (group, rank).

    Of groups that were crawled again the new rows count, and earlier rows of theirs only for keys that weren't fetched; groups that
    weren't keep their earlier rows. Rows of groups without a rank come last. Repeated keys keep their first row by ``order``.
    """
    mine = fetched.withColumn("__age", F.lit(0))
    both = mine.unionByName(prior.withColumn("__age", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(group, key).orderBy("__age", order))
    kept = both.withColumn("__nth", nth).where("__nth = 1").join(F.broadcast(groups), group, "left")  # one row for each group of the site
    return kept.orderBy(F.col("rank").asc_nulls_last(), group, order, key).drop("__age", "__nth")
