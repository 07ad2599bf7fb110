"""Stored inverted index: stems, positions, weighted fields, top-k that skips blocks.

Layout, as tables under one path:

* ``runs`` (term, block, data, ids): what a task finds in a block, one row for each term and one without a term for all the block's texts. ``data``
  has the number of texts, for each text its place in the block, the length of each field and, but for the row without a term, where the places of each
  field end, then all places. The other tables are made from it, so places of words are exchanged once, a block at a time.
* ``docs`` (ordinal, id, and the length of each field). Ordinals follow the ids; 128 of them make a block.
* ``postings`` (part, term, block, top, entries): one row for a term in a block, with the ordinals, impacts and positions of its texts there and
  the largest impact. Rows are sorted by term and block and dealt by range to ``part`` folders, so a query reads the folders of its terms; a
  term of many blocks may span several.
* ``terms`` (term, df), ``ranges`` (part, first, last), ``facts`` (one row: number of texts, mean lengths).

The impact of a term in a text is the weighted sum over fields of BM25's saturated frequency; the score of a text is the sum over the query's
terms of impact by inverse document frequency. A block's largest score is at most the sum of its terms' largest impacts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..sources.scratch import kept
from ..sources.tables import small_batches
from .search import STOP_WORDS, Query, parse_query

BLOCK_BITS, FIELD_BITS = 7, 32
#: Words whose stems a task keeps; beyond it the store starts anew.
STEMS_KEPT = 200_000
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    ranges: DataFrame
    texts: int
    stemmed: bool

    def analyse(self, word: str) -> str:
        return stem(word) if self.stemmed else word


def _inverted(stemmed: bool):
    """Texts (ordinal, id, lower-case fields) as ``runs``. A task holds one block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stem_of = re.compile("[a-z0-9]+").findall, {}
        block, ids, held, found, id_type = None, [], [], {}, None

        def out() -> pa.RecordBatch:
            data = [[n, *heads, *places] for n, heads, places in found.values()] + [[len(ids), *held]]
            columns = [pa.array([*found, None], pa.string()), pa.array([block] * len(data), pa.int64()), pa.array(data, pa.list_(pa.int32())), pa.array([None] * len(found) + [ids], pa.list_(id_type))]
            return pa.RecordBatch.from_arrays(columns, names=["term", "block", "data", "ids"])

        for batch in batches:
            id_type = batch.column(1).type
            for ordinal, key, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ordinal >> BLOCK_BITS != block:
                    if ids:
                        yield out()
                    block, ids, held, found = ordinal >> BLOCK_BITS, [], [], {}
                said: dict[str, list[list[int]]] = {}
                head = [ordinal & ((1 << BLOCK_BITS) - 1)]
                for i, text in enumerate(texts):
                    every = words(text)
                    head.append(len(every))
                    for place, word in enumerate(every):
                        if word not in STOP_WORDS:
                            if word not in said:
                                said[word] = [[] for _ in texts]
                            said[word][i].append(place)
                if stemmed:
                    by_stem: dict[str, list[list[int]]] = {}
                    for word, places in said.items():
                        if word not in stem_of:
                            if len(stem_of) >= STEMS_KEPT:
                                stem_of.clear()
                            stem_of[word] = stem(word)
                        other = by_stem.get(stem_of[word])
                        by_stem[stem_of[word]] = [sorted(a + b) for a, b in zip(other, places, strict=True)] if other else places
                    said = by_stem
                for term, fields in said.items():
                    row = found.setdefault(term, [0, [], []])
                    row[0] += 1
                    row[1] += head
                    for places in fields:
                        row[2] += places
                        row[1].append(len(row[2]))
                ids.append(key)
                held += head
        if ids:
            yield out()

    return run


def build(docs: DataFrame, id_col: str, fields: dict[str, float], path: str, stemmed: bool = True, parts: int = 64) -> Index:
    """Write the index of ``docs`` under ``path`` and open it.

    Words are runs of a-z and 0-9 of the lower-cased text. Stop words are left out but keep their place, so phrases keep
    their distances. A null field is empty; rows with a null or repeated id are texts of their own; an empty table gives an empty
    index. ``parts`` is the number of ranges of terms.
    """
    spark, names = docs.sparkSession, list(fields)
    texts = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"t{i}") for i, f in enumerate(names)]
    ordered = docs.select(F.col(id_col).alias("id"), *texts).repartitionByRange("id").sortWithinPartitions("id")
    numbered = small_batches(ordered.select(F.monotonically_increasing_id().alias("ordinal"), "*"))
    found = numbered.mapInArrow(_inverted(stemmed), f"term string, block bigint, data array<int>, ids array<{ordered.schema['id'].dataType.simpleString()}>")
    runs = kept(found, f"{path}/runs")

    held = runs.where("term IS NULL").select("block", "data", F.posexplode("ids").alias("i", "id"))
    at = F.col("i") * (1 + len(names)) + 1
    lengths = [F.get("data", at + 1 + i).cast("bigint").alias(f"len{i}") for i in range(len(names))]
    rows = held.select((F.shiftleft("block", BLOCK_BITS) + F.get("data", at)).alias("ordinal"), "id", *lengths)
    rows = kept(rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal"), f"{path}/docs")
    facts = kept(rows.agg(F.count("*").alias("texts"), F.lit(stemmed).alias("stemmed"), *(F.avg(f"len{i}").alias(f"avg{i}") for i in range(len(names)))), f"{path}/facts").first()

    width, count = 1 + 2 * len(names), F.get("data", F.lit(0))

    def entry(nth: Column) -> Column:
        first = nth * width + 1  # where the text's numbers begin
        before = F.when(nth > 0, F.get("data", first - 1)).otherwise(0)
        impact, places = F.lit(0.0), []
        for i, weight in enumerate(fields.values()):
            end = F.get("data", first + 1 + len(names) + i)
            tf = end - before
            norm = K1 * (1 - B + B * F.get("data", first + 1 + i) / F.lit(max(facts[f"avg{i}"] or 1.0, 1e-9)))
            impact = impact + F.lit(float(weight)) * tf * (K1 + 1) / (tf + norm)
            places.append(F.transform(F.slice("data", count * width + 2 + before, tf), lambda p: p.cast("bigint") + (i << FIELD_BITS)))  # noqa: B023
            before = end
        return F.struct((F.shiftleft("block", BLOCK_BITS) + F.get("data", first)).alias("ordinal"), impact.alias("impact"), (F.concat(*places) if places[1:] else places[0]).alias("places"))

    # Rows are exchanged and sorted as flat lists; entries are made of them as they are written.
    blocks = runs.where("term IS NOT NULL").drop("ids").repartitionByRange(parts, "term", "block").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "term", "block")
    blocks = blocks.select("term", "block", F.transform(F.sequence(F.lit(0), count - 1), entry).alias("entries"), "part")
    dealt = blocks.select("term", "block", F.array_max("entries.impact").alias("top"), "entries", "part")
    dealt.write.partitionBy("part").parquet(f"{path}/postings")
    postings = _read_postings(spark, path, dealt)
    kept(postings.groupBy("term").agg(F.sum(F.size("entries")).alias("df")).repartitionByRange("term").sortWithinPartitions("term"), f"{path}/terms")
    kept(postings.groupBy("part").agg(F.min("term").alias("first"), F.max("term").alias("last")), f"{path}/ranges")
    return opened(spark, path)


def _read_postings(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    schema = "term string, block bigint, top double, entries array<struct<ordinal: bigint, impact: double, places: array<bigint>>>, part int"
    return spark.read.schema(like.schema if like is not None else schema).parquet(f"{path}/postings")


def opened(spark: SparkSession, path: str) -> Index:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("docs", "terms", "ranges")}
    facts = spark.read.parquet(f"{path}/facts").first()
    return Index(postings=_read_postings(spark, path), texts=facts.texts, stemmed=facts.stemmed, **tables)


def _analysed(index: Index, q: Query) -> Query:
    one = lambda p: tuple(index.analyse(t) for t in p)
    return Query(tuple(map(one, q.all)), tuple(tuple(map(one, g)) for g in q.any), tuple(map(one, q.none)))


def postings_of(index: Index, terms: list[str]) -> DataFrame:
    """The postings of some terms, from the folders whose range has one of them."""
    if not terms:
        return index.postings.where("false")
    ranges = [tuple(r) for r in index.ranges.select("part", "first", "last").collect()]  # one row for each part
    parts = sorted({p for p, first, last in ranges if any(first <= t <= last for t in terms)})
    return index.postings.where(F.col("part").isin(parts) & F.col("term").isin(terms)) if parts else index.postings.where("false")


def _words(phrase: tuple[str, ...]) -> list[str]:
    return [t for t in phrase if t]


def _together(held: Column, phrase: tuple[str, ...]) -> Column:
    """Whether a text, by its map from term to places, has the phrase: its words at their distances within one field."""
    words = [(i, t) for i, t in enumerate(phrase) if t]
    first, rest = words[0], words[1:]
    at = lambda t: F.coalesce(F.element_at(held, F.lit(t)), F.array().cast("array<bigint>"))
    if not rest:
        return F.size(at(first[1])) > 0
    return F.exists(at(first[1]), lambda p: reduce(lambda a, b: a & b, (F.array_contains(at(t), p + (i - first[0])) for i, t in rest)))


def _holds(q: Query, has) -> Column:
    tests = [has(p) for p in q.all] + [reduce(lambda a, b: a | b, map(has, g)) for g in q.any]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def _scores(index: Index, q: Query, rows: DataFrame, idf: dict[str, float]) -> DataFrame:
    """(ordinal, score) of the texts in ``rows`` of postings that satisfy the query."""
    entry = rows.select("term", F.explode("entries").alias("e")).select("term", "e.*")
    weight = F.create_map(*(x for t, v in idf.items() for x in (F.lit(t), F.lit(v)))) if idf else F.create_map()
    found = entry.groupBy("ordinal").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("held"), F.sum(F.coalesce(F.element_at(weight, F.col("term")), F.lit(0.0)) * F.col("impact")).alias("score"))
    good = _holds(q, lambda p: _together(F.col("held"), p))
    for p in q.none:
        good = good & ~_together(F.col("held"), p)
    return found.where(good).select("ordinal", F.round("score", 9).alias("score"))


def _asked(index: Index, text: str) -> tuple[Query, DataFrame, dict[str, float]]:
    q = _analysed(index, parse_query(text))
    rows = postings_of(index, q.terms)
    wanted = sorted({t for p in [*q.all, *(p for g in q.any for p in g)] for t in _words(p)})
    known = {r.term: r.df for r in index.terms.where(F.col("term").isin(wanted)).collect()} if wanted else {}  # the query's terms
    idf = reduce(lambda out, t: out | {t: _idf(index.texts, known[t])}, known, {})
    return q, rows, idf


def _idf(n: int, df: int) -> float:
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def matching(index: Index, text: str) -> DataFrame:
    """(id, score) of every text that satisfies the query."""
    q, rows, idf = _asked(index, text)
    return index.docs.join(_scores(index, q, rows, idf), "ordinal").select("id", "score")


def search(index: Index, text: str, k: int = 20) -> DataFrame:
    """The ``k`` best texts: id, score, rank; equal scores by id.

    Blocks that lack a wanted term are never opened. Of the others those of the highest bounds are scored first; the k-th score found there is
    a floor, and only blocks whose bound reaches it are scored after that. The result is that of scoring all.
    """
    q, rows, idf = _asked(index, text)
    weight = F.create_map(*(x for t, v in idf.items() for x in (F.lit(t), F.lit(v)))) if idf else F.create_map()
    heads = rows.groupBy("block").agg(F.collect_set("term").alias("has"), F.sum(F.coalesce(F.element_at(weight, F.col("term")), F.lit(0.0)) * F.col("top")).alias("bound"))
    heads = heads.where(_holds(q, lambda p: reduce(lambda a, b: a & b, (F.array_contains("has", t) for t in _words(p)))))

    def best(blocks: DataFrame) -> DataFrame:
        return _scores(index, q, rows.join(blocks.select("block"), "block", "left_semi"), idf).orderBy(F.desc("score"), "ordinal").limit(k)

    first = best(heads.orderBy(F.desc("bound"), "block").limit(max(8, k))).collect()  # k rows
    floor = first[-1].score if len(first) == k else float("-inf")
    top = best(heads.where(F.col("bound") * (1 + 1e-9) + 1e-9 >= floor)).collect()  # k rows
    ranked = index.docs.sparkSession.createDataFrame([(r.ordinal, r.score, i + 1) for i, r in enumerate(top)], "ordinal bigint, score double, rank int").coalesce(1)
    docs = index.docs.where(F.col("ordinal").isin([r.ordinal for r in top]))  # sorted by ordinal: few row groups are read
    return docs.select("ordinal", "id").join(F.broadcast(ranked), "ordinal").select("id", "score", "rank")
