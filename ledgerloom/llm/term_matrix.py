"""Operator 12: audit of how filters interact, over a sparse document-term matrix.

1. One scan cuts the documents into shards and builds a CSR block of each: its words (a local dictionary), row pointers,
   word codes and counts, and beside them what the other filters need of a text. A text is never split.
2. The shards' dictionaries, not the words of texts, are exchanged, once: a range of words gets global codes in the order of their bytes.
   A shard's dictionary is in that order too, so the codes that come back, sorted, are those of its words. A word has one row for
   each shard, so none is hot.
3. The blocks are turned to global codes, sorted within rows. Row sums and the number of nonzero entries of a row
   decide the filters on lengths and distinct words.
4. Rows of documents meet the least id of an equal text and their labels, and are summed to one row for each part and
   combination of failures. All orders of the filters are then read from these few sums.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_apart, materialize, small_batches, text_bytes

#: Bytes of text in a shard, unless one text is longer.
SHARD_BYTES = 6 << 20
LETTERS = "ABCDE"
SIGNS = b"#$%&*|"

#: Words of a dictionary in one row.
WORDS_ROW = 8192

_FACTS = "ids array<bigint>, parts array<string>, points array<bigint>, capitals array<bigint>, signs array<boolean>, digests array<binary>"
#: Row pointers and codes are little-endian integers of 8 and 4 bytes, counts of 1 or 4; rows of words have nothing else.
_SHARD = f"shard bigint, {_FACTS}, starts binary, codes binary, counts binary, words array<string>"
_CSR = f"shard bigint, {_FACTS}, starts array<bigint>, codes array<bigint>, counts array<bigint>"
_SUMS = "doc_id bigint, part string, points bigint, capitals bigint, signs boolean, digest binary, n_words bigint, n_distinct bigint"


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def csr(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, starts, codes, counts) of the texts' words, runs without ASCII white space: row i has the distinct codes and their counts
    at ``starts[i]`` to ``starts[i + 1]``. Codes follow the words' bytes."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = split.flatten()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(texts)), sizes)[filled]
    held = words.filter(pa.array(filled)).dictionary_encode()
    if not len(held):
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    width = len(held.dictionary)
    order = pc.sort_indices(held.dictionary)
    place = np.empty(width, np.int64)
    place[order.to_numpy()] = np.arange(width)
    cells = rows * width
    cells += place[held.indices.to_numpy(zero_copy_only=False)]
    cells, counts = np.unique(cells, return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(texts) + 1) * width)
    return held.dictionary.take(order).cast(pa.string()), starts.astype(np.int64), (cells % width).astype(np.int32), counts.astype(np.int32)


def _count_per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


_CAPITAL, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN[list(SIGNS)] = True


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text) of a task as shards: a row with the block of each, then rows with the words of its dictionary."""
    lists = [pa.list_(t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())]
    schema = pa.schema(list(zip(_names(_SHARD), [pa.int64(), *lists, pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())])))

    def shard(name: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, parts, texts = (rows.column(i).combine_chunks() for i in range(3))
        data, offsets = text_bytes(texts)
        view = memoryview(data)
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in itertools.pairwise(offsets.tolist())]
        facts = [ids, parts, pa.array(_count_per_row((data & 0xC0) != 0x80, offsets)), pa.array(_count_per_row(_CAPITAL[data], offsets)), pa.array(_count_per_row(_SIGN[data], offsets) > 0), pa.array(digests, pa.binary())]
        words, starts, codes, counts = csr(texts)
        narrow = "<u1" if counts.max(initial=0) < 256 else "<u4"
        blobs = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((starts, "<i8"), (codes, "<i4"), (counts, narrow))]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in facts]
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *whole, *blobs, pa.nulls(1, schema.field("words").type)], schema=schema)
        for at in range(0, len(words), WORDS_ROW):
            part = words.slice(at, WORDS_ROW)
            part = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.nulls(1, f.type) for f in schema if f.name not in ("shard", "words")), part], schema=schema)

    held, size, name = [], 0, TaskContext.get().partitionId() << 33
    for batch in batches:
        _, offsets = text_bytes(batch.column(2))
        start = 0
        for i, n in enumerate(np.diff(offsets).tolist()):
            if size and size + n > SHARD_BYTES:
                held.append(batch.slice(start, i - start))
                yield from shard(name, pa.Table.from_batches(held))
                held, size, start, name = [], 0, i, name + 1
            size += n + 16
        held.append(batch.slice(start))
    if held and sum(b.num_rows for b in held):
        yield from shard(name, pa.Table.from_batches(held))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, shard, code) of rows sorted by word: the partition's number, then the number of distinct words before it."""
    last, rank = None, -1
    base = TaskContext.get().partitionId() << 33
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(0)
        new = np.ones(len(words), bool)
        new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or words[0].as_py() != last
        codes = rank + np.cumsum(new)
        last, rank = words[len(words) - 1].as_py(), int(codes[-1])
        yield pa.RecordBatch.from_arrays([words, batch.column(1), pa.array(base + codes)], names=["word", "shard", "code"])


def global_codes(words: DataFrame) -> DataFrame:
    """(word, shard, code) of rows (word, shard): equal words have equal codes, and codes rise with the words' bytes. They aren't dense: a range of words
    begins anew. One exchange, which never parts the rows of a word."""
    return words.select("word", "shard").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_coded, "word string, shard bigint, code bigint")


def _block(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, codes, counts) of a shard over global codes, sorted within its rows."""
    get = {name: row.column(k)[0] for k, name in enumerate(row.schema.names) if name in ("starts", "codes", "counts", "global")}
    starts, codes = np.frombuffer(get["starts"].as_buffer(), "<i8"), np.frombuffer(get["codes"].as_buffer(), "<i4")
    raw = get["counts"].as_buffer()
    counts = np.frombuffer(raw, "<u1" if raw.size == len(codes) else "<u4").astype(np.int64)
    codes = get["global"].values.to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, np.int64)
    order = np.lexsort((codes, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
    return starts, codes[order], counts[order]


def _recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of shards as lists over global codes."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in _block(row)]
            yield pa.RecordBatch.from_arrays([*(row.column(row.schema.get_field_index(n)) for n in _names(_CSR)[:-3]), *lists], names=_names(_CSR))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document in shards the sum of its row and the number of its nonzero entries."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            starts, codes, counts = _block(row)
            first = np.zeros(len(codes) + 1, bool)
            first[1:-1] = codes[1:] != codes[:-1]
            first[starts] = True
            sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (counts, first[:-1])]
            facts = [row.column(row.schema.get_field_index(n)).flatten() for n in _names(_FACTS)]
            yield pa.RecordBatch.from_arrays([*facts, *(pa.array(x[starts[1:]] - x[starts[:-1]]) for x in sums)], names=_names(_SUMS))


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sparse matrix of ``docs`` as CSR shards over global codes, and its dictionary (word, code).

    A shard holds some rows' ids, parts, code points, capitals, signs and SHA-256, row pointers, codes and counts. Null texts are empty
    rows, null parts are the empty string; null and repeated ids stay as they are; a very long text is a shard of its own.
    """
    shards = _cut(docs, id_col, text_col, part_col)
    coded = materialize(global_codes(_dictionaries(shards)), "dictionary")
    return _joined(shards, coded).mapInArrow(_recode, _CSR), coded.select("word", "code").distinct()


def _cut(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_shards, _SHARD), "shards")


def _dictionaries(shards: DataFrame) -> DataFrame:
    return shards.where("words IS NOT NULL").select("shard", F.explode("words").alias("word"))


def _joined(shards: DataFrame, coded: DataFrame) -> DataFrame:
    """Blocks with ``global``: the code of each word of their dictionary."""
    found = coded.groupBy("shard").agg(F.sort_array(F.collect_list("code")).alias("global"))
    blocks = shards.where("starts IS NOT NULL").drop("words").join(found, "shard", "left")
    return blocks.withColumn("global", F.coalesce("global", F.array().cast("array<bigint>")))


def row_sums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each document, from the matrix: doc_id, part, points, capitals, signs, digest, n_words (row sum), n_distinct (nonzero entries)."""
    shards = _cut(docs, id_col, text_col, part_col)
    return _joined(shards, global_codes(_dictionaries(shards))).mapInArrow(_sums, _SUMS)


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failed, good, toxic, n): documents by part, the filters they fail (bit i: filter i of ABCDE) and their labels.

    Ids that repeat in ``labels`` count as labelled if any row of theirs is. A document without an id has no label, and neither
    repeats another nor is repeated.
    """
    rows = row_sums(docs, id_col, text_col, part_col)
    bits: list[Column] = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), 100 * F.col("capitals") > 2 * F.col("points"), F.col("signs")]
    failed = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    # Equal rows are counted before any of them moves: one id, text or part may hold most rows.
    summed = materialize(rows.groupBy("doc_id", "digest", "part", failed.alias("failed")).agg(F.count("*").alias("n")), "failed")
    first = summed.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    copies = materialize(first.where("copies > 1"), "copies")
    repeated = join_apart(summed.where("doc_id IS NOT NULL"), copies, "digest", n="copies").where("doc_id > first").select("doc_id", "digest").distinct()
    summed = summed.join(repeated.withColumn("again", F.lit(1 << LETTERS.index("E"))), ["doc_id", "digest"], "left")
    summed = summed.groupBy("doc_id", "part", (F.col("failed") + F.coalesce("again", F.lit(0))).alias("failed")).agg(F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = summed.where("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(summed.where("doc_id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}))
    return named.groupBy("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For every part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A: under 200 words; B: distinct words under half of all; C: capitals over 2 % of the code points; D: a sign of ``#$%&*|``; E: equal to the
    text of a smaller id. A null part is the empty string. A null or empty text fails A, and E if a smaller id has an empty one; rows
    that repeat an id are each counted, and don't repeat one another; rows without an id never fail E. Extra columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    cells = materialize(failures(docs, labels, id_col, text_col, part_col), "cells")
    orders = F.lit(["".join(o) for o in itertools.permutations(LETTERS)])
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    letters = F.lit(list(LETTERS))
    earlier = F.aggregate(F.sequence(F.lit(0), F.lit(len(LETTERS) - 1)), F.lit(0), lambda m, i: m + F.when(F.expr("substr(filter_order, 1, step - 1)").contains(letters[i]), F.pow(F.lit(2), i).cast("int")).otherwise(0))
    bit = F.pow(F.lit(2), F.array_position(letters, F.expr("substr(filter_order, step, 1)")) - 1).cast("int")
    steps = steps.withColumns({"bit": bit, "earlier": earlier})
    fails, gone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("earlier")) != 0

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0)).cast("bigint")

    out = steps.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone & (F.col("good") == 1)).alias("good_lost"),
        total(fails & ~gone & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    # Over all orders, a filter comes first among the k that a document fails in one of k.
    each = cells.select("part", "failed", "n", F.explode(F.lit([1 << i for i in range(len(LETTERS))])).alias("bit"))
    share = F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n") * F.expr("120 div bit_count(failed)")).otherwise(0)
    shapley = each.groupBy("part", "bit").agg(F.sum(share).cast("bigint").alias("shapley"))
    return out.join(shapley, ["part", "bit"]).drop("bit").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
