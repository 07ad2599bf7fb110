"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two group-bys with map-side minima and two joins with these. The edges of one vertex meet in one task of a join,
as narrow rows of two ids; adaptive execution splits that where it is large. Each round's edges are a table in the shared folder.

Before the first round the edges that stand together are joined where they are, a block at a time, which leaves one star for each
component of a block and saves most rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame) -> DataFrame:
    """Large star: link each larger neighbour with the least of the neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Small star: link each smaller neighbour, and the vertex, with the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges that are joined together before the first round.
BLOCK_EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges from each vertex to the least of its component."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array([find(x) for x in range(len(names))], np.int64)
    keep = top != np.arange(len(names))
    return names[keep], names[top[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(u, v)], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_EDGES:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reachable.

    Null ends and loops are ignored; edges may repeat. Empty input gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
    now, before = materialize(now.mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state.n == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = state
        now = materialize(_small(_star(now)), "edges")
