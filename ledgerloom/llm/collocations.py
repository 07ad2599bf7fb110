"""Operator 11: phrase collocations by Toivonen's sampling.

A sample of the documents is mined level by level at a lowered threshold and proposes phrases. One full pass then counts the proposed phrases and
their negative border: all phrases that aren't proposed but whose first and last parts (all words but one) are, and all other words. A
border phrase that turns out frequent is a *failure*: its extensions weren't counted. An expansion pass counts the failures and what they
open; a phrase that it opens may itself be extended at once, so the phrases are closed after it: both parts of a
frequent phrase are frequent, so each was counted in the full pass or is opened here, and so is the phrase.

What is proposed is known to the tasks as a bitmap of a fixed size; a false hit in it only has more phrases counted, never fewer. Proposed
phrases are summed by their strings. The border, by far the largest part, is summed by hashes, which can only raise a sum; what
reaches the threshold there is counted by its string in the expansion pass. So every count that is used is of a phrase, not of a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_apart, materialize, small_batches, text_bytes
from .shingles import mix, word_hashes

#: Share of the documents in the sample, and part of the threshold (of the sample's share) at which it proposes. A lower part has fewer failures, which
#: are cheap, and a larger border, which isn't.
SAMPLE, LOWERED = 0.2, 1.0
#: Bits of a hash that are left out: 48 are kept, as a row of the border is hardly more than its hash.
SHORT = np.uint64(16)
#: Bits of a bitmap of phrases (8 MB), two for each phrase.
BITS = 1 << 26
#: Bytes of text whose counts are taken together.
BLOCK_BYTES = 6 << 20
#: Parts in which the phrases of one language are ranked before their best meet.
RANK_SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def lowered(min_count: int, sample: float, part: float = LOWERED) -> int:
    return max(2, int(min_count * sample * part))


class Words:
    """Words of a block of texts: codes of distinct (language, word), the normalized text they stand in, and which are followed without a break."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = text_bytes(texts)
        data, kind = _LOWER[data], _KIND[data]
        inside = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate([inside[1:] & ~first[1:-1], [False]]) if len(data) else inside
        ends = np.flatnonzero(inside & ~after) + 1
        self.n = len(starts)
        piece = np.searchsorted(np.flatnonzero((kind == 2) | first[:-1]), starts, side="right")
        self.follows = np.zeros(self.n, bool)
        self.follows[:-1] = piece[1:] == piece[:-1]
        # Words one after the other, each with a space behind it.
        at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        self.text = np.full(int(at[-1]), 0x20, np.uint8)
        keep = np.ones(int(at[-1]), bool)
        keep[at[1:] - 1] = False
        self.text[keep] = data[inside]
        self.at = at
        row = np.searchsorted(offsets, starts, side="right") - 1
        del data, kind, inside, first, before, after, keep, starts, ends, piece
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary
        lang_of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] if self.n else np.zeros(0, np.int64)
        whole = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(self.text)])
        held = whole.dictionary_encode()
        words = held.indices.to_numpy(zero_copy_only=False).astype(np.int64) if self.n else np.zeros(0, np.int64)
        width = max(1, len(held.dictionary))
        del whole, row
        self.firsts, self.codes, self.counts = number_dense(lang_of * width + words, width * max(1, len(self.langs)))
        self.lang = lang_of[self.firsts]
        del lang_of, words, held
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.as_py().encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.hashes = mix(self._word_hash() ^ seeds[self.lang]) >> SHORT if len(self.firsts) else np.zeros(0, np.uint64)

    def _word_hash(self) -> np.ndarray:
        """Hashes of the distinct words, of their own bytes alone."""
        text, at = self.strings(self.firsts, 1)
        return word_hashes(text, at)[0]

    def strings(self, firsts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the phrases that begin at some words."""
        begin, end = self.at[firsts], self.at[firsts + words] - 1
        at = np.concatenate([[0], np.cumsum(end - begin)])
        take = np.arange(int(at[-1])) + np.repeat(begin - at[:-1], end - begin)
        return self.text[take], at


def number(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key its first place and its count; and the number of each key among the distinct."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    _, firsts, codes, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return firsts, codes.astype(np.int32), counts


def number_dense(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of keys from 0 to ``width``, without sorting them where a table of ``width`` is no larger than a few times the keys."""
    if width > 8 * len(keys) + 1024:
        return number(keys)
    counts = np.bincount(keys, minlength=width)
    present = np.flatnonzero(counts)
    codes, firsts = np.zeros(width, np.int32), np.zeros(width, np.int64)
    codes[present] = np.arange(len(present), dtype=np.int32)
    firsts[keys[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return firsts[present], codes[keys], counts[present]


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    again = mix(hashes ^ _SEED)
    return (hashes % np.uint64(BITS)).astype(np.int64), (again % np.uint64(BITS)).astype(np.int64)


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _bits(hashes)
    return ((bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def phrases(words: Words, most: int, held: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, first places, counts, hashes) of the distinct phrases of a block, level by level: words, then phrases whose both parts are held.

    ``held`` is asked once for each level, with the hashes of its phrases and the numbers of their parts in the level before (none for words), which
    of them may be part of longer ones. Phrases are numbered from pairs of shorter ones, never by hashes.
    """
    n, at, hashes, firsts, counts, parts = 1, words.codes, words.hashes, words.firsts, words.counts, None
    while len(firsts):
        open_ = held(n, hashes, parts)
        yield n, firsts, counts, hashes
        if n == most:
            return
        left, right = at[:-1], at[1:]
        # Two phrases of two words and more that begin at neighbours overlap, so they stand in one piece.
        places = np.flatnonzero(words.follows[:-1] if n == 1 else (left >= 0) & (right >= 0))
        places = places[open_[left[places]] & open_[right[places]]]
        left, right = left[places], right[places]
        firsts, codes, counts = number(left.astype(np.int64) * len(hashes) + right)
        parts = left[firsts], right[firsts]
        at = np.full(words.n, -1, np.int32)
        at[places] = codes
        firsts, n = places[firsts], n + 1
        # The hash of a phrase is that of its first part and its last word, so it is the same in every block.
        hashes = mix(hashes[parts[0]] * _STEP + words.hashes[words.codes[firsts + n - 1]]) >> SHORT


_COUNTED = "lang string, words int, phrase string, hash bigint, f bigint"


def _rows(words: Words, n: int, firsts: np.ndarray, counts: np.ndarray, hashes: np.ndarray, named: bool) -> Iterator[pa.RecordBatch]:
    """Counts as rows of _COUNTED; phrases that aren't named have their hash alone."""
    langs = words.langs.cast(pa.string())
    for a in range(0, len(firsts), 200_000):
        part, size = firsts[a : a + 200_000], len(firsts[a : a + 200_000])
        if named:
            text, at = words.strings(part, n)
            phrase = pa.Array.from_buffers(pa.string(), size, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text)])
            lang, length = langs.take(pa.array(words.lang[words.codes[part]])), pa.array(np.full(size, n, np.int32))
        else:
            lang, length, phrase = pa.nulls(size, pa.string()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.string())
        yield pa.RecordBatch.from_arrays([lang, length, phrase, pa.array(hashes[a : a + 200_000].view(np.int64)), pa.array(counts[a : a + 200_000])], names=["lang", "words", "phrase", "hash", "f"])


def _level(level: int, inside) -> Callable:
    """(hash, f) of the phrases of ``level`` words whose parts are inside; of all words at level 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if inside is None else np.frombuffer(inside.value, np.uint8)
        for block in _blocks(batches):
            for n, _, counts, hashes in phrases(Words(block.column(1), block.column(0)), level, lambda n, hashes, _: holds(bitmap, hashes) if n < level else None):
                if n == level:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["hash", "f"])

    return run


def _full(most: int, proposed) -> Callable:
    """The full pass: proposed phrases by name, their negative border by hash, and the number of words of each language (of length 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(proposed.value, np.uint8)
        for block in _blocks(batches):
            words, known = Words(block.column(1), block.column(0)), {}

            def held(n: int, hashes: np.ndarray, parts) -> np.ndarray:
                known[n] = holds(bitmap, hashes)  # noqa: B023
                return known[n]  # noqa: B023

            for n, firsts, counts, hashes in phrases(words, most, held):
                if n == 1:
                    totals = np.bincount(words.lang, weights=counts, minlength=len(words.langs)).astype(np.int64)
                    size = len(totals)
                    yield pa.RecordBatch.from_arrays([words.langs.cast(pa.string()), pa.array(np.zeros(size, np.int32)), pa.array([""] * size), pa.array(np.zeros(size, np.int64)), pa.array(totals)], names=["lang", "words", "phrase", "hash", "f"])
                for named, of in ((True, known[n]), (False, ~known[n])):
                    yield from _rows(words, n, firsts[of], counts[of], hashes[of], named)

    return run


def _expansion(most: int, proposed, frequent) -> Callable:
    """The expansion pass: failures of the border, and the phrases that the full pass didn't visit and whose parts are frequent or such themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = (np.frombuffer(x.value, np.uint8) for x in (proposed, frequent))
        for block in _blocks(batches):
            words, was, counted = Words(block.column(1), block.column(0)), {}, {}

            def held(n: int, hashes: np.ndarray, parts) -> np.ndarray:
                visited = np.ones(len(hashes), bool) if n == 1 else was[n - 1][parts[0]] & was[n - 1][parts[1]]  # noqa: B023
                # A false hit of the bitmap on a phrase that the full pass never came to was no proposal there.
                was[n], inside = visited & holds(before, hashes), holds(now, hashes)  # noqa: B023
                counted[n] = ~visited | (~was[n] & inside)  # noqa: B023
                return inside | ~visited

            for n, firsts, counts, hashes in phrases(words, most, held):
                of = counted[n]
                yield from _rows(words, n, firsts[of], counts[of], hashes[of], True)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of about BLOCK_BYTES of text."""

    def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        return table.to_batches()[0] if table.num_rows else rows[0]

    held, size = [], 0
    for batch in batches:
        n = batch.column(1).nbytes
        if held and size + n > BLOCK_BYTES:
            yield joined(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield joined(held)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(hashes)) + 1)], names=["bit"])


def bitmap_of(hashes: DataFrame) -> bytes:
    """A bitmap of BITS bits over the column ``hash``. The driver sees one row of 4 KB for each 32,768 bits, however many phrases there are."""
    bits = hashes.select("hash").mapInArrow(_positions, "bit bigint")
    buckets = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(BITS // 8)
    for row in buckets.collect():  # BITS / 32,768 rows at most
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    return bytes(out)


def proposals(texts: DataFrame, low: int, most: int) -> bytes:
    """The bitmap of the phrases of up to ``most`` words that stand ``low`` times in a sample and whose parts do: one small pass for each length."""
    found, inside = None, None
    for level in range(1, most + 1):
        sent = None if inside is None else texts.sparkSession.sparkContext.broadcast(inside)
        new = texts.mapInArrow(_level(level, sent), "hash bigint, f bigint").groupBy("hash").agg(F.sum("f").alias("f")).where(f"f >= {low}").select("hash")
        new = materialize(new, "proposed")
        found = new if found is None else found.unionByName(new)
        inside = bitmap_of(found)
    return inside


def frequent_phrases(texts: DataFrame, min_count: int, most: int, proposed: bytes) -> tuple[DataFrame, DataFrame]:
    """All (lang, words, phrase, f) of up to ``most`` words with f >= ``min_count``, and (lang, n) of all words, whatever is ``proposed``."""
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(proposed)
    keys = ["lang", "words", "phrase", "hash"]
    full = texts.mapInArrow(_full(most, sent), _COUNTED).groupBy(*keys).agg(F.sum("f").alias("f"))
    full = materialize(full.where(f"f >= {min_count} OR words = 0"), "full")
    totals = full.where("words = 0").select("lang", F.col("f").alias("n"))
    found, border = full.where("words > 0 AND phrase IS NOT NULL"), full.where("phrase IS NULL")
    found = found.select("lang", "words", "phrase", "f")
    if border.isEmpty():
        return found, totals
    frequent = context.broadcast(bitmap_of(full.where("words IS NULL OR words > 0")))
    more = texts.mapInArrow(_expansion(most, sent, frequent), _COUNTED).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return found.unionByName(materialize(more.where(f"f >= {min_count}"), "expanded")), totals


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two words and more: the cut of the lowest score, of equals the first."""
    word = F.split("phrase", " ")
    cuts = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(F.array_join(F.slice(word, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(word, k + 1, F.col("words") - k), " ").alias("tail")))).alias("k", "cut"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", "cut.*")
    for end, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(end), F.col("f").alias(name)), ["lang", end])
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(a as {wide}) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut"))
    return join_apart(best, totals, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def not_inside(found: DataFrame, num: int, den: int) -> DataFrame:
    """(lang, phrase) of the phrases with ``den`` * f(longer) >= ``num`` * f of a longer phrase that holds their words side by side."""
    word = F.split("phrase", " ")
    spans = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(word, i, n), " ")))
    parts = found.where("words > 2").select("lang", F.explode(F.flatten(spans)).alias("phrase"), F.col("f").alias("longer"))
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"]).where(F.col("longer") * F.lit(den).cast("decimal(10,0)") >= F.col("f") * F.lit(num).cast("decimal(10,0)")).select("lang", "phrase")


def best_of_each(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase. The best of each of RANK_SALTS parts of a language are found first, so no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))
    part = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(f"rank <= {top}").drop("salt", "rank")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(f"rank <= {top}")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, most: int = 4, top: int = 2000, num: int = 80, den: int = 100, sample: float = SAMPLE) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into words. A phrase of 2 to ``most`` words that
    stands at least ``min_count`` times within pieces is scored by its worst cut, floor(2,000,000 * a / (l + r)), and dropped if a longer
    candidate holds it with num/den of its count. A null text is empty, a null language is ``und``. Rows count each for itself, whatever their
    ids; texts of any length are read whole; ties go by count, then by the phrase's bytes. An empty table, or one without a frequent
    phrase, gives no rows. Other columns are ignored. ``sample`` and the bitmaps change the work, never the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = materialize(texts.sample(sample, 17), "sample")
    found, totals = frequent_phrases(texts, min_count, most, proposals(drawn, lowered(min_count, sample), most - 1))
    rows = scored(found, totals)
    rows = rows.join(not_inside(found, num, den), ["lang", "phrase"], "left_anti")
    return best_of_each(rows, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
