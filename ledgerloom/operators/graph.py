"""One-hop citation graphs from edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inside(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with both ends among ``seeds`` (id)."""
    return edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi")


def neighbours(edges: DataFrame, seeds: DataFrame, most: int = 30, enough: int = 3) -> DataFrame:
    """(id, degree) of what seeds cite beyond themselves: cited twice or more if there are ``enough`` such, the top ``most``."""
    out = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    degree = out.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("degree"))
    common = degree.agg(F.count_if(F.col("degree") >= 2).alias("n_common"))
    kept = degree.join(F.broadcast(common)).where((F.col("n_common") < enough) | (F.col("degree") >= 2))  # one row
    return kept.select("id", "degree").orderBy(F.desc("degree"), "id").limit(most)


def hub(edges: DataFrame, centre: int, most: int = 30) -> DataFrame:
    """(id, shared) of documents that cite what the centre is cited beside: siblings by number of common sources."""
    citing = edges.where(F.col("dst") == centre).select("src").distinct()
    return edges.join(citing, "src", "left_semi").where(F.col("dst") != centre).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("shared")).orderBy(F.desc("shared"), "id").limit(most)


def ego(edges: DataFrame, node: int) -> DataFrame:
    """The node and its neighbours either way."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id")).union(edges.where(F.col("dst") == node).select(F.col("src").alias("id"))).union(edges.sparkSession.range(node, node + 1)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, cites, cited_by), each side aggregated before they meet."""
    a = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("cites"))
    b = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("cited_by"))
    return a.join(b, "id", "full").fillna(0, ["cites", "cited_by"])


def top_per_source(edges: DataFrame, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return edges.distinct().withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def drawn(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) with their in-degree over all edges and a radius of 10 to 38, and the edges with both ends among them."""
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    sized = nodes.join(degree, "id", "left").fillna(0, ["in_degree"])
    most = sized.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("most"))
    radius = F.lit(10.0) + F.lit(28.0) * F.col("in_degree") / F.col("most")
    return sized.join(F.broadcast(most)).withColumn("radius", radius).drop("most"), inside(edges, nodes)  # one row


def seeds_of(ranked: DataFrame, edges: DataFrame, most: int = 40, share: float = 0.7, cited: float = 0.3) -> DataFrame:
    """(id, rank) of the ``most`` best of ``ranked`` (id, score): its score by ``share`` and the decimal logarithm of one and its in-degree by ``cited``.

    The degree is summed before the join; equal ranks go by id.
    """
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("degree"))
    rank = share * F.col("score") + cited * F.log10(1 + F.coalesce("degree", F.lit(0)))
    return ranked.join(degree, "id", "left").select("id", F.round(rank, 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(most)


def around(edges: DataFrame, seeds: DataFrame, kinds: DataFrame | None = None, most: dict[str, int] | int = 30, always: tuple[str, ...] = (), enough: int = 3) -> tuple[DataFrame, DataFrame]:
    """The graph around ``seeds`` (id, rank): nodes (id, kind, tier, rank, degree) and edges (src, dst), as one expansion.

    Primary nodes are the seeds, secondary ones what seeds cite beyond themselves, with the number of seeds that cite them. Of a kind of which ``enough`` are
    cited twice or more only these are kept, but for kinds that are ``always`` kept; then the most cited of each kind, at most ``most`` of it. Edges are
    those between seeds and from seeds to secondary nodes that stay. ``kinds`` (id, kind) may leave nodes out; their kind is null, as are all without it.
    """
    outward = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    beyond = outward.join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    degree = beyond.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    named = degree.join(kinds, "id", "left") if kinds is not None else degree.withColumn("kind", F.lit(None).cast("string"))
    kind = F.coalesce("kind", F.lit(""))
    cap = F.lit(most) if isinstance(most, int) else F.coalesce(*(F.when(kind == k, n) for k, n in most.items()), F.lit(0))
    common = named.groupBy(kind.alias("kind_")).agg(F.count_if(F.col("degree") >= 2).alias("common"))
    kept = named.withColumn("kind_", kind).join(common, "kind_").where((F.col("degree") >= 2) | (F.col("common") < enough) | F.col("kind_").isin(*always))
    nth = F.row_number().over(Window.partitionBy("kind_").orderBy(F.desc("degree"), "id"))
    kept = kept.withColumn("nth", nth).where(F.col("nth") <= cap)
    seed_kinds = seeds.join(kinds, "id", "left") if kinds is not None else seeds.withColumn("kind", F.lit(None).cast("string"))
    primary = seed_kinds.select("id", "kind", F.lit("primary").alias("tier"), "rank", F.lit(0).cast("bigint").alias("degree"))
    secondary = kept.select("id", "kind", F.lit("secondary").alias("tier"), F.lit(0.0).alias("rank"), "degree")
    nodes = primary.unionByName(secondary)
    return nodes, outward.select("src", "dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def around_hub(edges: DataFrame, hubs: DataFrame, dates: DataFrame, most: int = 40, siblings: int = 15) -> tuple[DataFrame, DataFrame]:
    """The graph around ``hubs`` (id): nodes (id, tier, degree) and edges.

    Citing nodes cite a hub; they are ranked by the number of hubs cited, their own in-degree and their date (``dates``: id, date), newest first, and the
    first ``most`` stay. Siblings are cited by these and are no hubs, ranked by how many cite them. Edges run from citing nodes to hubs and siblings kept.
    """
    to_hubs = edges.join(hubs.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
    cites = to_hubs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    cited = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("cited_by"))
    citing = cites.join(cited, "id", "left").join(dates, "id", "left").withColumn("cited_by", F.coalesce("cited_by", F.lit(0)))
    citing = citing.orderBy(F.desc("degree"), F.desc("cited_by"), F.col("date").desc_nulls_last(), "id").limit(most).select("id", "degree")
    outward = edges.join(citing.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    beside = outward.join(hubs.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    beside = beside.orderBy(F.desc("degree"), "id").limit(siblings)
    parts = ((hubs.select("id", F.lit(0).cast("bigint").alias("degree")), "hub"), (citing, "citing"), (beside, "sibling"))
    named = [df.select("id", F.lit(tier).alias("tier"), "degree") for df, tier in parts]
    nodes = named[0].unionByName(named[1]).unionByName(named[2])
    ends = nodes.where("tier <> 'citing'").select(F.col("id").alias("dst"))
    return nodes, outward.join(ends, "dst", "left_semi").select("src", "dst")
