"""Operator 4: document fingerprints from closed syncmers, in built-in functions only.

A k-mer of words is an anchor when the least of its inner s-mers stands at its start or end. That depends on the k-mer
alone, so texts that share a passage share its anchors, wherever it stands. K - 1 empty words are set before and after each
text: by the window guarantee of closed syncmers every text with a word then has anchors, and each word lies in
one. A fingerprint is all anchors of the text in order, each as its distance to the one before and its hash, so it has their positions.

Likeness matches anchors by hash (the first of each) and weighs what is shared, as a share of all distinct anchors of the two,
by how far the shared ones stand in one order: 1 less Spearman's footrule as a share of its most, which is 0 if the order is
reversed. Passages put in do not shift that order; passages that moved do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize
from .quality import let, words_of

K, S = 5, 2
#: Bits of a position in a packed anchor; words beyond 2 ** 23 share the last position in likeness (not in fingerprints' order).
POSITION = 23
#: Rows of one bucket of neighbours, and the quantiles of the ids that the buckets subdivide.
BUCKET_ROWS, QUANTILES = 1_000, 256
BROADCAST_HEADS = 100_000
_LAST = (1 << POSITION) - 1


def _closed(smers: Column, at: Column) -> Column:
    inner = K - S + 1
    edge = F.least(F.get(smers, at), F.get(smers, at + inner - 1))
    return edge <= F.least(*(F.get(smers, at + j) for j in range(1, inner - 1)))


def anchors(words: Column) -> Column:
    """array<struct<pos, hash>> of the closed syncmers, in order of their positions; hashes have 40 bits. No words: none."""

    def from_hashes(h: Column) -> Column:
        smers = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
        chosen = lambda sm: F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: _closed(sm, i))
        return F.transform(let(smers, chosen), lambda i: F.struct(i.alias("pos"), F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(K))), 24).alias("hash")))

    edge = F.array_repeat(F.lit(""), K - 1)
    some = let(F.transform(F.concat(edge, words, edge), lambda w: F.xxhash64(w)), from_hashes)
    return F.when(F.size(words) > 0, some).otherwise(F.expr("CAST(array() AS array<struct<pos:int,hash:bigint>>)"))


def sketch(text: Column) -> Column:
    """The anchors of a text."""
    return anchors(words_of(text))


def fingerprint(found: Column) -> Column:
    """Anchors as a string: a hex digit for the distance to the anchor before (the window guarantee keeps it below K) and ten for the hash."""

    def of(f: Column) -> Column:
        gap = lambda a, i: F.when(i == 0, a["pos"]).otherwise(a["pos"] - F.get(f, i - 1)["pos"])
        return F.lower(F.array_join(F.transform(f, lambda a, i: F.concat(F.hex(gap(a, i)), F.lpad(F.hex(a["hash"]), 10, "0"))), ""))

    return let(found, of)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; equal anchors have 1, as have two texts without any."""

    def of(m: Column) -> Column:
        # Anchors of both, by hash; of each hash the first of ``a`` is followed by the first of ``b``.
        at = F.sequence(F.lit(0), F.size(m) - 2)
        key = lambda j: F.shiftright(F.get(m, j), POSITION + 1)
        side = lambda j: F.shiftright(F.get(m, j), POSITION).bitwiseAND(1)
        distinct = F.lit(1) + F.size(F.filter(at, lambda j: key(j) != key(j + 1)))
        pairs = F.transform(
            F.filter(at, lambda j: (key(j) == key(j + 1)) & (side(j) == 0) & (side(j + 1) == 1)),
            lambda j: F.shiftleft(_LAST - F.get(m, j).bitwiseAND(_LAST), POSITION) + F.get(m, j + 1).bitwiseAND(_LAST),
        )
        return let(F.sort_array(pairs), lambda p: F.size(p) / distinct * let(F.size(p).cast("bigint"), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(1 - 2 * footrule(p) / (n * n))))

    def footrule(pairs: Column) -> Column:
        ranked = F.sort_array(F.transform(pairs, lambda x, i: F.shiftleft(x.bitwiseAND(_LAST), POSITION) + i))
        return F.aggregate(F.transform(ranked, lambda x, r: F.abs(x.bitwiseAND(_LAST) - r)), F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def both(a: Column, b: Column) -> Column:
        packed = lambda x, pos: F.shiftleft(x["hash"], POSITION + 1).bitwiseOR(pos.cast("bigint"))
        first = F.transform(a, lambda x: packed(x, _LAST - F.least(x["pos"], F.lit(_LAST))))
        second = F.transform(b, lambda x: packed(x, F.least(x["pos"], F.lit(_LAST)) + (1 << POSITION)))
        return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(F.sort_array(F.concat(first, second)), of))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: both(s["a"], s["b"]))


def _bucketed(rows: DataFrame) -> DataFrame:
    """``bucket`` rises with the id: quantiles of all ids, each cut in even parts of about BUCKET_ROWS rows. Rows without an id come
    below, in buckets of their hash."""
    stats = rows.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)]).alias("q"), F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    bounds, parts = sorted(set(stats.q or [0])), max(1, stats.n // QUANTILES // BUCKET_ROWS)
    if stats.n < QUANTILES * BUCKET_ROWS:
        bounds = bounds[:: max(1, QUANTILES * BUCKET_ROWS // max(1, stats.n))]
    at = F.array(*(F.lit(int(b)).cast("bigint") for b in bounds))
    q = F.greatest(F.size(F.filter(at, lambda b: b <= F.col("doc_id"))), F.lit(1))
    low, high = F.get(at, F.col("q") - 1), F.coalesce(F.get(at, F.col("q")), F.lit(int(bounds[-1])).cast("bigint"))
    share = (F.col("doc_id") - low).cast("double") / F.greatest(F.lit(1.0), (high - low).cast("double"))
    sub = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts)))
    none = -1 - F.floor((F.col("tie") / float(1 << 63) + 0.5) * max(1, stats.none // BUCKET_ROWS))
    return rows.withColumn("q", q).withColumn("bucket", F.when(F.col("doc_id").isNull(), none).otherwise(F.col("q") * (1 << 31) + sub).cast("bigint"))


def _with_next(rows: DataFrame) -> DataFrame:
    """``next_text`` and ``next_sketch`` of the row that follows by falling id (ties by a hash of the text), cyclic.

    Each bucket gets a copy of the first row of the bucket below it, so that neighbours always meet in a bucket.
    """
    heads = rows.groupBy("q", "bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), (-F.col("tie")).alias("t"))).alias("head"))
    by_q = heads.groupBy("q").agg(F.max("bucket").alias("top"))  # QUANTILES rows at most
    by_q = by_q.select("q", F.coalesce(F.lead("top").over(Window.orderBy(F.desc("q"))), F.max("top").over(Window.partitionBy())).alias("after"))
    below = F.lead("bucket").over(Window.partitionBy("q").orderBy(F.desc("bucket")))
    links = heads.withColumn("below", below).join(F.broadcast(by_q), "q").select(F.col("bucket").alias("above"), F.coalesce("below", "after").alias("bucket"))
    first = heads.join(links, "bucket").select("above", F.col("bucket").alias("b"), F.col("head.k").alias("k"), F.col("head.t").alias("t"))
    # The first rows are as many as the buckets. Few enough (under 5 MB), they are sent to the scan; else the texts are shuffled.
    first = materialize(first, "heads")
    first = F.broadcast(first) if first.count() <= BROADCAST_HEADS else first
    extra = rows.join(first, (F.col("bucket") == F.col("b")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("k")) & (-F.col("tie") == F.col("t")))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra.select(*(F.col("above").alias(c) if c == "bucket" else F.col(c) for c in rows.columns), F.lit(1).alias("extra")))
    # Texts travel, anchors don't: they are found after the shuffle that the window needs anyway.
    both = both.repartition("bucket").withColumn("sketch", sketch(F.col("text")))
    falling = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "tie")
    return both.withColumn("next_text", F.lead("text").over(falling)).withColumn("next_sketch", F.lead("sketch").over(falling)).where("extra = 0")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint. A null text counts as empty; other columns are ignored."""
    return id_text(docs, id_col, text_col).select("doc_id", fingerprint(sketch(F.col("text"))).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the last floor(n/2) code points replaced by the first of the next text.

    The next row is that of the next lower id; the lowest is followed by the highest. Rows of one id follow each other by
    a hash of their texts, rows without id come last. A single row follows itself. A null text counts as empty. Texts that
    differ in ASCII white space only have equal fingerprints; a text without any is one word, however long. Other columns are ignored.
    """
    rows = _bucketed(id_text(docs, id_col, text_col).withColumn("tie", F.shiftright(F.xxhash64("text"), 1)))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = _with_next(rows).withColumn("n_chars", F.length("text"))
    pairs = pairs.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr("next_text", F.lit(1), half)))
    pairs = pairs.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    # The sketch of the edit is read several times below: without this barrier it would be worked out for each.
    pairs = pairs.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
