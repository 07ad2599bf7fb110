"""Operator 3: best-fit packing by minimum bin slack.

A bin is filled by the largest length left and the fullest feasible combination of the other lengths, which a
bitset subset-sum program finds; the combination is then removed, as often as the lengths' counts allow. Only the
histogram of lengths takes part in that (at most ``capacity`` rows, however many pieces there are). The pieces are
then ranked within their length, in small salted groups, and the rank gives bin and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize, slices, small_batches, text_bytes
from .word_ids import word_ids


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how often) of a combination with the greatest sum up to ``capacity``; lengths fall."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in lengths:
        if length > capacity:
            continue
        left, chunk = min(counts[length], capacity // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, chunk = left - take, chunk * 2
        if reach >> capacity:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            found[length] = found.get(length, 0) + take
    return list(found.items())


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, how often in each)]) that use up ``counts``. Every round at least halves a length's count."""
    counts, plan = {k: v for k, v in counts.items() if v}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        rest = fullest(lengths, counts, capacity - top) if top < capacity else []
        counts[top] += 1
        uses = dict(rest)
        uses[top] = uses.get(top, 0) + 1
        bins = min(counts[length] // n for length, n in uses.items())
        plan.append((bins, sorted(uses.items(), reverse=True)))
        for length, n in uses.items():
            counts[length] -= bins * n
        if any(not counts[length] for length in uses):
            lengths = [x for x in lengths if counts[x]]
    return plan


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            data, at = text_bytes(batch.column(1))
            data, ids, out = data.tobytes(), batch.column(0).to_pylist(), []
            for i, doc_id in enumerate(ids):
                coded = coder.encode(data[at[i] : at[i + 1]]) + end
                for piece, start in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[start : start + 4 * capacity]
                    out.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


_SPAN = 1 << 45


def _seat(plan):
    """Bin and offset of each ranked piece, from the plan's ranges of ranks of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first_bin, per_bin, offset = plan.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = np.searchsorted(keys, length * _SPAN + rank, side="right") - 1
            nth = rank - (keys[i] - length * _SPAN)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first_bin[i] + nth // per_bin[i]), pa.array(offset[i] + nth % per_bin[i] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences hold up to ``capacity`` ids.

    A document is its ids and then ``end_id``; only one longer than ``capacity`` is cut. A null or empty text is the
    end id alone. Rows with a null or repeated id are packed as documents of their own. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialize(id_text(docs, id_col, text_col).mapInArrow(_cut(tokenizer, capacity, end_id), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows

    keys, first_bin, per_bin, offset = [], [], [], []
    used, bin_at = dict.fromkeys(counts, 0), 0
    for bins, uses in plan_bins(counts, capacity):
        place = 0
        for length, n in uses:
            keys.append(length * _SPAN + used[length])
            first_bin.append(bin_at)
            per_bin.append(n)
            offset.append(place)
            used[length] += bins * n
            place += length * n
        bin_at += bins
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    plan = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (keys, first_bin, per_bin, offset)])

    # A length may hold a third of all pieces: it is dealt to groups of about the square root of its count, at least 256.
    # It comes as an Arrow table: of a list the executors would read every row back in Python workers of another kind, which stay.
    salts = spark.createDataFrame(pa.table({"length": pa.array(counts.keys(), pa.int64()), "salts": pa.array([-(-n // max(256, int(n**0.5))) for n in counts.values()], pa.int64())}))
    dealt = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), "salts"))
    sizes = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = dealt.withColumn("nth", nth).join(base, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).cast("bigint").alias("rank"))
    return ranked.mapInArrow(_seat(plan), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
