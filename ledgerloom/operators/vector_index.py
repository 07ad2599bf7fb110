"""Vector index of centroid lists: vectors are stored by their nearest centroid, and a query reads the lists nearest to it.

Centroids come from k-means over a bounded sample (``SAMPLE`` vectors); every vector is indexed. Probing all lists is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 20_000


@dataclass(frozen=True)
class Lists:
    rows: DataFrame
    centroids: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                unit = _unit(flat)
                near = (unit @ centroids.T).argmax(axis=1)
                at = np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(unit.ravel())), pa.array(near.astype(np.int32))], names=["id", "unit", "list"])

    return run


def build(vectors: DataFrame, id_col: str, vector_col: str, path: str, lists: int = 32, seed: int = 7) -> Lists:
    """Write the index of ``vectors``, all of one length, under ``path`` and open it. Rows without a vector are left out; fewer vectors than ``lists`` make fewer lists."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    n = rows.count()
    drawn = rows.sample(min(1.0, SAMPLE / n), seed).limit(SAMPLE) if n > SAMPLE else rows
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("vector", lambda x: x / F.when(length > 0, length).otherwise(1.0))
    if n:
        model = KMeans(k=max(2, min(lists, n)), seed=seed, featuresCol="unit", maxIter=10).fit(drawn.select(array_to_vector(unit).alias("unit")))
        centroids = _unit(np.array(model.clusterCenters()))
    else:
        centroids = np.zeros((1, 1))
    rows.mapInArrow(_assigned(centroids), "id bigint, unit array<double>, list int").repartition("list").write.partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Lists:
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # one row for each list
    rows = spark.read.schema("id bigint, unit array<double>, list int").parquet(f"{path}/lists")
    return Lists(rows, np.array([r.centroid for r in centroids]))


def nearest(index: Lists, query: list[float], k: int = 20, probe: int = 8) -> DataFrame:
    """(id, similarity) of the ``k`` most similar vectors by cosine in the ``probe`` lists nearest to the query; equal ones by id."""
    wanted = _unit(np.array([query], np.float64))[0]
    lists = np.argsort(-(index.centroids @ wanted), kind="stable")[:probe].tolist()
    dot = F.aggregate(F.zip_with("unit", F.lit([float(x) for x in wanted]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = index.rows.where(F.col("list").isin(lists)) if probe < len(index.centroids) else index.rows
    return rows.select("id", F.round(dot, 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def _scored(centroids: np.ndarray, k: int, probe: int, ids: list[int], wanted: np.ndarray):
    near = [set(np.argsort(-(centroids @ w), kind="stable")[:probe].tolist()) for w in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            out = []
            for q, (i, likeness) in enumerate(zip(ids, wanted @ unit.T, strict=True)):
                best = np.lexsort((names, -likeness))[:k]
                out += [(i, int(names[b]), float(likeness[b]), int(lists[b]) in near[q]) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["query", "id", "similarity", "probed"])

    return run


def recall(index: Lists, queries: DataFrame, k: int = 10, probe: int = 8) -> DataFrame:
    """(query, recall) of each of ``queries`` (id, vector; a stated, bounded set): the share of its ``k`` nearest of all vectors that probing finds.

    Every task keeps the best ``k`` of its batches for each query, so a few rows for each query and batch are exchanged.
    """
    asked = queries.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).collect()
    wanted = _unit(np.array([r.vector for r in asked], np.float64))
    found = index.rows.mapInArrow(_scored(index.centroids, k, probe, [r.id for r in asked], wanted), "query bigint, id bigint, similarity double, probed boolean").distinct()
    order = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "id", "probed")))
    top = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"), F.bool_or("probed").alias("probed")).groupBy("query").agg(F.slice(order, 1, k).alias("best"))
    return top.select("query", (F.size(F.filter("best", lambda b: b["probed"])) / F.size("best")).alias("recall"))
