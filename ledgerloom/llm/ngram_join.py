"""Operator 1: n-gram Jaccard join over a count-vector R-tree.

The shingles of a text are hashed into groups; the number of shingles in each group makes the text a point,
and the sum of coordinate minima of two points bounds the overlap of their sets. Points are found in two levels:

* Routing, the upper levels. For texts of size up to b, linked sets differ in at most t = 2b(1-J)/(1+J) shingles. Splitting
  the hash range in more than t blocks leaves a block where linked sets agree in full, so one key per block
  routes every linked pair into a common node of the index. There are more blocks than needed, and by so many as there are more a text
  leaves out the keys that most texts hold: of the keys on which a linked pair agrees the rarest stays in both. Nothing that links is lost.
* Packed R-trees below. The count vectors of a node are cut in tiles, and each tile's points are packed into an R-tree, together with
  the node's least text. A branch is skipped if even its largest coordinates can't reach the overlap needed. Every candidate comes
  from a search of such a tree; none is tested otherwise.

Candidates are verified on the exact sets in two rounds: for each text the nearest that each tree holds before it, and its lead; then, for
nodes still in several components, whatever trees over every pair of their tiles reach across these. Texts travel only for pairs that the trees reach. Pairs inside one component
aren't expanded, so a group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, join_apart, materialize, slices, small_batches
from .components import components
from .shingles import mix, shingle_sets

#: Groups of a count vector: the largest power of two up to the size of the set, within these bounds.
LEAST_GROUPS, MOST_GROUPS = 64, 8192
#: Texts in one tile of a node.
TILE = 512
#: Up to this many candidates (8 MB of ids) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of one partner that meet in one task; the text of a partner of more is sent to several.
PARTNER_PAIRS = 64


#: The low bits of a key tell the step of the grid of its blocks.
STEP_BITS = 6


def _need(tau: int) -> int:
    return tau + 1 + (tau + 9) // 10 if tau else 1


def _blocks(tau: int) -> tuple[int, int]:
    """Blocks for sets that differ in at most ``tau`` shingles, and their step: from a coarse grid, so that near sizes share it."""
    m, step = 1, 0
    while m < _need(tau):
        m, step = max(m + 1, m * 7 // 5), step + 1
    return m, step


def _most(m: int) -> int:
    """The most differences of sets that ``m`` blocks are made for."""
    tau = m * 10 // 11
    while _need(tau) > m:
        tau -= 1
    while _need(tau + 1) <= m:
        tau += 1
    return tau


class Router:
    """Keys of the blocks of a set; linked sets share one at least, also without as many of the most frequent keys of each step as its slack."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.made = num, den, {}

    def tau(self, size: int) -> int:
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """(blocks, step, most differences) of every pair in which this is the smaller or the larger set."""
        if size not in self.made:
            top = size * self.den // self.num
            (m, step), (high, _) = _blocks(self.tau(size)), _blocks(self.tau(top))
            found = [(m, step)]
            while m < high:
                m, step = max(m + 1, m * 7 // 5), step + 1
                found.append((m, step))
            self.made[size] = [(m, step, min(self.tau(top), _most(m))) for m, step in found]
        return self.made[size]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        return self.keys_and_slack(shingles)[0]

    def keys_and_slack(self, shingles: np.ndarray) -> tuple[np.ndarray, int, list[int]]:
        """Keys of all steps, the first step, and the slack of each step from that on."""
        size, found, slack = len(shingles), [], []
        if not size:
            return np.zeros(0, np.uint64), 0, []
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
        high = (shingles >> np.uint64(32)).astype(np.int64)
        for m, step, most in self.classes(size):
            edge = np.searchsorted(high, (np.arange(m + 1, dtype=np.int64) << 32) // m)
            edge[-1] = size
            sums, filled = total[edge[1:]] - total[edge[:-1]], edge[1:] > edge[:-1]
            key = mix(sums + np.uint64(m * 0xD6E8FEB86659FD93 % 2**64) + np.arange(m, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
            key = (key & ~np.uint64((1 << STEP_BITS) - 1)) | np.uint64(step)
            # Agreement in a block without shingles is no key, unless those without could be all that agree.
            n = int(filled.sum())
            found.append(key[filled] if n > most else key)
            slack.append(max(0, n - most - 1))  # of n keys at least n - most agree
        return np.concatenate(found), self.classes(size)[0][1], slack


def _sign(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, seen = Router(num, den), set()
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), k)
            ids = batch.column(0)
            a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            keys, first, slack = [], [], []
            for i, s in enumerate(sets):
                same = (int(a[i]), int(b[i]), len(s))
                # A copy met before in this task sends no keys again: copies are joined by their set, see classes.
                if not len(s) or not ids[i].is_valid or same in seen:
                    keys.append(np.zeros(0, np.int64))
                    first.append(0)
                    slack.append([])
                    continue
                if len(seen) < 200_000:
                    seen.add(same)
                own, step, spare = router.keys_and_slack(s)
                keys.append(own.view(np.int64))
                first.append(step)
                slack.append(spare)
            sizes = np.array([len(s) for s in sets], np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            # Only a row that sends keys can be asked for its text.
            silent = np.array([not len(x) for x in keys])
            text = batch.column(1).take(pa.array(np.arange(len(keys)), mask=silent))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys))), pa.array(first, pa.int32()), pa.array(slack, pa.list_(pa.int32())), text],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "first_step", "slack", "text"],
            )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key repeats, and those at the ends of the partition, whose key may go on elsewhere."""

    def out(keys, ids, keep):
        return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep])], names=["key", "node"])

    last_key, last_id, sent, first = None, None, True, True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        same = keys[1:] == keys[:-1]
        keep = np.zeros(len(keys), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if first:
            keep[0], first = True, False
        elif keys[0] == last_key:
            keep[0] = True
            if not sent:
                yield out(np.array([last_key]), np.array([last_id]), np.array([True]))
        last_key, last_id, sent = keys[-1], ids[-1], bool(keep[-1])
        yield out(keys, ids, keep)
    if last_key is not None and not sent:
        yield out(np.array([last_key]), np.array([last_id]), np.array([True]))


def groups_of(size: int) -> int:
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(0, size.bit_length() - 1)))


def count_vector(shingles: np.ndarray, groups: int = 0) -> np.ndarray:
    groups = groups or groups_of(len(shingles))
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def pack_vector(vector: np.ndarray) -> bytes:
    return vector.astype("<u1" if vector.max(initial=0) < 256 else "<u4").tobytes()


def unpack_vector(raw: bytes, size: int) -> np.ndarray:
    groups = groups_of(size)
    return np.frombuffer(raw, "<u1" if len(raw) == groups else "<u4").astype(np.int32)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """The same counts over fewer groups."""
    return vector.reshape(-1, groups).sum(axis=0) if len(vector) > groups else vector


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """Most overlap of two sets, by the summed minima of their counts."""
    groups = min(len(a), len(b))
    return int(np.minimum(fold(a, groups), fold(b, groups)).sum())


def overlap_needed(a, b, num: int, den: int):
    """Least overlap i of sets of sizes a and b with den * i >= num * (a + b - i)."""
    return -(-(num * (a + b)) // (num + den))


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.intersect1d(x, y, assume_unique=True).size
    return den * both >= num * (len(x) + len(y) - both)


class CountTree:
    """Packed R-tree over count vectors: leaves are runs of the sorted points, parents hold coordinate maxima and the least size."""

    FANOUT = 8

    def __init__(self, points: np.ndarray):
        self.order = np.lexsort((*points[:, :6].T[::-1], points.sum(axis=1)))
        self.levels = [(points[self.order], points.sum(axis=1)[self.order])]
        while len(self.levels[-1][0]) > 1:
            high, least = self.levels[-1]
            at = np.arange(0, len(high), self.FANOUT)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at)))

    def search(self, point: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose summed minima with ``point`` reach the overlap needed, most overlap first, and these sums."""
        size, at, bound = int(point.sum()), np.arange(len(self.levels[-1][0])), np.zeros(0)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[depth]
            bound = np.minimum(high[at], point).sum(axis=1)
            alive = bound >= overlap_needed(size, least[at], num, den)
            at, bound = at[alive], bound[alive]
            if depth and len(at):
                below = (at[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                at = below[below < len(self.levels[depth - 1][0])]
        best = np.argsort(-bound, kind="stable")
        return self.order[at[best]], bound[best]


def _vectors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([pack_vector(count_vector(s)) for s in sets], pa.binary()), batch.column(1)], names=["node", "size", "vector", "text"])

    return run


def _by_tile(search, width: int, types: list[pa.DataType], names: list[str]):
    """``search`` of the rows of each tile, which are told apart by the first ``width`` columns of sorted rows."""

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:width] != row[:width]:
                    found += search(held)
                    held = []
                held.append(row)
            if found:
                yield out(found)
        if held and (found := search(held)):
            yield out(found)

    return run


def _points(rows: list[tuple], size: int, vector: int) -> np.ndarray:
    vectors = [unpack_vector(r[vector], r[size]) for r in rows]
    groups = min(map(len, vectors))
    return np.array([fold(v, groups) for v in vectors])


def _nearest(num: int, den: int):
    """Per text of a tile (lead, chunk, node, size, vector) what the tree over the tile reaches from it: the nearest of the texts before it,
    and the lead. Rows (a, b, likeness): the text, its partner, and the most that their Jaccard similarity can be."""

    def search(rows: list[tuple]) -> list[tuple]:
        rows = sorted({r[2]: r for r in rows}.values(), key=lambda r: (r[2] != r[0], r[3], r[2]))
        points, found = _points(rows, 3, 4), []
        tree = CountTree(points)
        for p in range(1, len(rows)):
            at, most = tree.search(points[p], num, den)
            before = at < p
            at, most = at[before], most[before]
            if len(at):
                like = most / (rows[p][3] + np.array([rows[q][3] for q in at]) - most)
                best = int(np.argmax(like))
                found.append((rows[p][2], rows[at[best]][2], float(like[best])))
                if at[best] != 0 and (at == 0).any():
                    found.append((rows[p][2], rows[0][2], float(like[np.flatnonzero(at == 0)[0]])))
        return found

    return _by_tile(search, 2, [pa.int64(), pa.int64(), pa.float64()], ["a", "b", "likeness"])


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", "y"):
            keep = pa.array([linked(p, q, num, den) for p, q in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


_TILE = ["lead", "i", "j", "within"]


def _reached(num: int, den: int):
    """Of the rows of each tile those with a partner of another component that the tree can't rule out."""

    def search(rows: list[tuple]) -> list[tuple]:
        rows = list({r[4]: r for r in rows}.values())
        names = {c: n for n, c in enumerate(dict.fromkeys(r[5] for r in rows))}
        if len(names) < 2:
            return []
        component = np.array([names[r[5]] for r in rows])
        points = _points(rows, 7, 8)
        tree, hit = CountTree(points), np.zeros(len(rows), bool)
        for p, row in enumerate(rows):
            if row[6]:
                found, _ = tree.search(points[p], num, den)
                found = found[component[found] != component[p]]
                hit[found] = True
                hit[p] |= len(found) > 0
        return [rows[i][:7] for i in np.flatnonzero(hit)]

    return _by_tile(search, 4, [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()], [*_TILE, "node", "component", "probe"])


def _search_tile(k: int, num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links that join the components met in a tile: probes against the R-tree over all its points."""
        rows = rows.drop_duplicates("node")
        nodes, probes = rows["node"].to_numpy(), np.flatnonzero(rows["probe"].to_numpy())
        sets = shingle_sets(pa.array(rows["text"], pa.string()), k)
        groups = min(groups_of(len(s)) for s in sets)
        points = np.array([count_vector(s, groups) for s in sets])
        names, root = np.unique(rows["component"].to_numpy(), return_inverse=True)
        root, links = root.astype(np.int64), []
        tree = CountTree(points)
        for p in probes:
            for q in tree.search(points[p], num, den)[0]:
                if root[p] != root[q] and linked(sets[p], sets[q], num, den):
                    links.append((nodes[p], nodes[q]))
                    root[root == root[q]] = root[p]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _tiles(group: DataFrame) -> DataFrame:
    """Rows (lead, node, component) dealt to tiles in which every pair of different components meets.

    The largest component of a node of the index is never paired with itself; it and the rest are cut in
    chunks, so no group of rows grows with the input.
    """
    sizes = group.groupBy("lead", "component").agg(F.count("*").alias("n"))
    major = sizes.groupBy("lead").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n"))
    major = major.select("lead", "major", "n", F.ceil(F.col("n_major") / TILE).alias("c_major"), F.ceil((F.col("n") - F.col("n_major")) / TILE).alias("c_minor"))
    rows = join_apart(group, materialize(major, "majors"), "lead").withColumn("minor", F.col("component") != F.col("major"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.when(F.col("minor"), F.col("c_minor")).otherwise(F.col("c_major")))))
    minors = F.transform(F.sequence(F.lit(0), F.col("c_minor") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j"), F.lit(True).alias("within")))
    majors = F.transform(F.sequence(F.lit(0), F.col("c_major") - 1), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(False).alias("within")))
    across = F.transform(F.sequence(F.lit(0), F.col("c_minor") - 1), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(False).alias("within")))
    rows = rows.withColumn("tile", F.explode(F.when(F.col("minor"), F.concat(minors, majors)).otherwise(across)))
    return rows.select("lead", "tile.*", "node", "component", F.col("minor").alias("probe"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of at least
    num / den (tested in integers). Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than k words is one shingle.

    Null or empty texts, and texts of white space, have an empty set and link with nothing. Rows with a null id
    keep their n_shingles, take part in no link and have a null component_id. Rows that repeat an id are one
    document: they share a component, and each links by its own text. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = id_text(docs, id_col, text_col)
    # Rows get a number of their own, so an id with several texts is several nodes of the graph. Numbers rise within a task: of equal sets the least
    # number has sent keys.
    signed = texts.mapInArrow(_sign(k, num, den), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>, first_step int, slack array<int>, text string")
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    # Equal sets are one node: its least row.
    same = ["set_a", "set_b", "n_shingles"]
    live = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("row", "doc_id", *same)
    classes = materialize(live.groupBy(*same).agg(F.min("row").alias("node"), F.count("*").alias("n")).where("n > 1"), "classes")
    copies = materialize(join_apart(live, classes, *same).select("row", "doc_id", "node"), "copies")

    routed = signed.select(F.explode("keys").alias("key"), "row").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    members = routed.mapInArrow(_repeated, "key bigint, node bigint").join(copies.select(F.col("row").alias("node"), F.col("node").alias("first")), "node", "left")
    members = materialize(members.select("key", F.coalesce("first", "node").alias("node")).distinct(), "keys")
    # A text leaves out its most frequent keys, as many as its slack; all texts rank keys alike.
    counts = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    step = F.col("key").bitwiseAND((1 << STEP_BITS) - 1).cast("int")
    by_count = F.row_number().over(Window.partitionBy("node", "step").orderBy(F.desc("n"), "key"))
    ranked = join_apart(members, counts, "key").select("key", "node", step.alias("step"), "n").withColumn("nth", by_count)
    spare = signed.where("text IS NOT NULL").select(F.col("row").alias("node"), "first_step", "slack")
    members = ranked.join(spare, "node").where(F.col("nth") > F.get("slack", F.col("step") - F.col("first_step"))).select("key", "node")
    members = materialize(members, "rare")
    leads = materialize(members.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1"), "leads")
    members = materialize(join_apart(members, leads, "key").where("node <> lead").select("lead", "node").distinct(), "members")

    nodes = materialize(members.select("node").union(members.select("lead")).distinct(), "nodes")
    points = _of(signed.where("text IS NOT NULL").select(F.col("row").alias("node"), "text"), nodes)
    points = materialize(points.mapInArrow(_vectors(k), "node bigint, size int, vector binary, text string"), "points")
    vectors, near = points.select("node", "size", "vector"), points.select("node", "text")
    # The texts of a node are dealt to tiles; its lead stands in each.
    sizes = materialize(members.groupBy("lead").agg(F.count("*").alias("n")).select("lead", "n", F.ceil(F.col("n") / TILE).alias("chunks")), "sizes")
    dealt = join_apart(members, sizes, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node")
    heads = sizes.select("lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.col("lead").alias("node"))
    tiles = dealt.unionByName(heads).join(vectors, "node").select("lead", "chunk", "node", "size", "vector").repartition("lead", "chunk").sortWithinPartitions("lead", "chunk")
    reach = materialize(tiles.mapInArrow(_nearest(num, den), "a bigint, b bigint, likeness double").select("a", "b").distinct(), "reach")

    # Every pair that a tree reaches is tested. The text of a partner of many is sent to as many tasks as it has pairs by PARTNER_PAIRS.
    salts = reach.groupBy("b").agg(F.ceil(F.count("*") / PARTNER_PAIRS).alias("salts")).where("salts > 1")
    pairs = reach.join(salts, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).alias("salt"))
    heads = _of(near, reach.select(F.col("b").alias("node"))).toDF("b", "y").join(salts, "b", "left").select("b", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    tested = pairs.join(_of(near, reach.select(F.col("a").alias("node"))).toDF("a", "x"), "a").join(heads, ["b", "salt"]).select("a", "b", "x", "y")
    # A table, as the components begin in Python too: one task would hold a worker for either, and both stay with the executor.
    links = materialize(tested.mapInArrow(_verify(k, num, den), "a bigint, b bigint"), "tested")
    found = components(links.unionByName(_same_id(live, copies)), "a", "b")

    # What is left are nodes of the index whose texts are in several components.
    every = members.union(sizes.select("lead", F.col("lead").alias("node")))
    named = materialize(every.join(found, "node", "left").select("lead", "node", F.coalesce("component", "node").alias("component")), "named")
    open_ = named.groupBy("lead").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("lead", "n")
    open_ = materialize(open_, "open")
    if not open_.isEmpty():
        tiles = _tiles(join_apart(named, open_, "lead").select("lead", "node", "component")).join(vectors, "node").select(*_TILE, "node", "component", "probe", "size", "vector")
        tiles = tiles.repartition(*_TILE).sortWithinPartitions(*_TILE)
        tiles = materialize(tiles.mapInArrow(_reached(num, den), "lead bigint, i bigint, j bigint, within boolean, node bigint, component bigint, probe boolean"), "tiles")
        more = materialize(tiles.join(_of(near, tiles.select("node")), "node").groupBy(*_TILE).applyInPandas(_search_tile(k, num, den), "a bigint, b bigint"), "links")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b")

    # From rows to nodes, from nodes to components, which are named by their least id.
    rows = live.select("row", "doc_id").join(copies.select("row", "node"), "row", "left").select("doc_id", F.coalesce("node", "row").alias("node"), F.col("node").isNotNull().alias("copied"))
    rows = rows.join(found, "node", "left").where("copied OR component IS NOT NULL").select("doc_id", F.coalesce("component", "node").alias("root"))
    rows = materialize(rows, "rooted")
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    named = join_apart(rows, least, "root").where("doc_id <> component_id").select("doc_id", "component_id").distinct()
    return signed.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``texts`` of some nodes, so that no other text is exchanged."""
    nodes = nodes.distinct()
    return texts.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi")


def _same_id(live: DataFrame, copies: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ids that have several: with the least of the id."""
    again = live.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    rows = join_apart(live.select("row", "doc_id"), materialize(again, "again"), "doc_id")
    rows = materialize(rows.join(copies.select("row", "node"), "row", "left").select("doc_id", F.coalesce("node", "row").alias("a"), "n").distinct(), "nodes")
    first = rows.groupBy("doc_id").agg(F.min("a").alias("b"), F.count("*").alias("n"))
    return join_apart(rows.select("doc_id", "a"), first, "doc_id").where("a <> b").select("a", "b")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Rows of ``docs`` whose id is the least of its component, all columns, whatever their names.

    Rows with a null id and those without words stay; rows that repeat an id are one document and stay or go together. An
    empty table stays empty.
    """
    found = jaccard_components(docs, id_col, text_col, k, num, den)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    kept = docs.toDF(*names).join(gone, F.col(names[docs.columns.index(id_col)]) == F.col("doc_id"), "left_anti")
    return kept.toDF(*docs.columns)
