"""Operator 9: quality rules with distribution divergence, in built-in functions only.

A text's histograms of character classes and of common words are compared with those of its language (all texts
of the language together) by the Jensen-Shannon distance (base 2, 0 to 1). Texts without a language, or of one with few
texts, are compared with all texts together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: Most distances to the language's histograms. Few words scatter by chance, so the second has WORD_SLACK / sqrt(words) more;
#: texts of fewer than MIN_WORDS words aren't judged by distance.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_SLACK, MIN_WORDS = 0.28, 0.2, 0.8, 50
#: A language of fewer texts has no reference of its own: a text would be compared with little but itself.
MIN_TEXTS = 20
#: Up to this many references (6 MB), of the languages of most texts, are broadcast; the others are joined by a shuffle, where no language has many rows.
BROADCAST_LANGUAGES = 10_000
#: Up to this many rejected rows (16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_REJECTED = 500_000

# Frequent function words of four languages, as any frequency list has them.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
_ALL_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})
#: Character classes; the last holds all other characters, small letters above all.
CLASSES = {
    "upper": "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]),
    "digit": "0123456789",
    "space": SPACES,
    "symbol": SYMBOLS,
    "punctuation": ".,;:!?'\"()-/",
    "rest": "",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the text has twice or more, the first included."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            again = lambda j: ((j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"]))
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(again(j), F.lit(False))), lambda j: F.get(s, j)["i"]))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("bigint").alias("n"))
        return F.aggregate(let(ordered, flagged), start, step, lambda acc: acc["n"])

    def all_windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def of(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered(windows))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(all_windows(w), of)))


def common_counts(words: Column) -> Column:
    """How often the text has each common word of any language, in their order."""
    cased = sorted({v for w in _ALL_COMMON for v in (w, w.capitalize(), w.upper())})
    some = F.transform(F.filter(words, lambda w: w.isin(cased)), F.lower)
    return let(some, lambda c: F.transform(F.array(*map(F.lit, _ALL_COMMON)), lambda r: F.size(F.filter(c, lambda w: w == r)).cast("double")))


def measures(text: Column, words: Column) -> list[Column]:
    """Everything that the rules look at, from one pass over the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    return [
        F.length(text).cast("bigint").alias("n_chars"), F.size(words).cast("bigint").alias("n_words"),
        *(_without(text, chars).cast("bigint").alias(f"not_{name}") for name, chars in CLASSES.items() if chars),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"), common_counts(words).alias("common"),
    ]


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; of an empty one, null."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def of(a: Column, b: Column) -> Column:
        return total(F.zip_with(a, b, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2))

    shares = lambda a: let(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t)))
    found = let(F.struct(shares(p).alias("p"), shares(q).alias("q")), lambda s: of(s["p"], s["q"]))
    return F.sqrt(F.when(found < 0, F.lit(0.0)).otherwise(found))  # rounding may fall below 0


def measured(docs: DataFrame, text_col: str, lang_col: str, *more: Column) -> DataFrame:
    """lang, the columns ``more`` and the measures of each row, and its classes; a table in the shared folder."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*more, F.col(lang_col).cast("string").alias("lang"), text.alias("__text"))
    names = [c for c in rows.columns if c != "__text"]
    rows = rows.select("*", words_of(F.col("__text")).alias("__words"))
    rows = materialize(rows.select(*names, *measures(F.col("__text"), F.col("__words"))), "measures")
    named = [(F.col("n_chars") - F.col(f"not_{name}")).cast("double") for name, chars in CLASSES.items() if chars]
    return rows.withColumn("classes", F.array(*named, F.col("n_chars") - sum(named[1:], named[0])))


def references(rows: DataFrame) -> DataFrame:
    """(lang, texts, ref_classes, ref_words, ref_n) of every language, null included, from the measures of all its texts: sums of counts."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(_ALL_COMMON))]
    total = rows.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n_words").cast("double").alias("ref_n"), *sums)
    return total.select("lang", "texts", F.array(*(f"c{i}" for i in range(len(CLASSES)))).alias("ref_classes"), F.array(*(f"w{i}" for i in range(len(_ALL_COMMON)))).alias("ref_words"), "ref_n")


def _with_references(rows: DataFrame) -> DataFrame:
    """``rows`` with the reference of their language (ref_*), null where it has none, and that of all rows (all_*)."""
    every = materialize(references(rows), "languages")
    sums = [F.array(*(F.sum(F.col(name)[i]) for i in range(n))).alias(f"all_{name[4:]}") for name, n in (("ref_classes", len(CLASSES)), ("ref_words", len(_ALL_COMMON)))]
    pooled = every.agg(*sums, F.sum("ref_n").alias("all_n"))
    own = every.where(F.col("lang").isNotNull() & (F.col("texts") >= MIN_TEXTS))
    few = own.count() <= BROADCAST_LANGUAGES
    most = own if few else materialize(own.orderBy(F.desc("texts"), "lang").limit(BROADCAST_LANGUAGES), "most")
    out = rows.join(F.broadcast(most.drop("texts")), "lang", "left")
    if not few:
        done = F.col("lang").isNull() | F.col("ref_n").isNotNull()
        rest = out.where(~done).drop("ref_classes", "ref_words", "ref_n").join(own.drop("texts").hint("shuffle_hash"), "lang", "left")
        out = out.where(done).unionByName(rest)
    return out.crossJoin(F.broadcast(pooled))  # one row


def _of_language(counts: Column, n: Column, lang: Column) -> Column:
    """Histogram over the language's own common words, the rest last; other languages: over all of the words."""
    out = None
    for name, words in COMMON_WORDS.items():
        own = [counts[_ALL_COMMON.index(w)] for w in words]
        hist = F.array(*own, F.greatest(F.lit(0.0), n - sum(own[1:], own[0])))
        out = F.when(lang == name, hist) if out is None else out.when(lang == name, hist)
    every = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    return out.otherwise(F.concat(counts, F.array(F.greatest(F.lit(0.0), n - every))))


def _any_common(counts: Column, n: Column) -> Column:
    """Histogram of two: common words of any language, and the rest. Against all texts, which words are common says only which language it is."""
    every = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    return F.array(every, F.greatest(F.lit(0.0), n - every))


def judged(rows: DataFrame) -> DataFrame:
    """Distances and verdicts of measured rows."""
    rows = _with_references(rows)
    alone = F.col("ref_n").isNull()
    rows = rows.withColumn("class_distance", _distance(F.col("classes"), F.when(alone, F.col("all_classes")).otherwise(F.col("ref_classes"))))
    lang = F.when(~alone, F.col("lang"))
    n_words = F.col("n_words").cast("double")
    own = F.when(alone, _any_common(F.col("common"), n_words)).otherwise(_of_language(F.col("common"), n_words, lang))
    ref = F.when(alone, _any_common(F.col("all_words"), F.col("all_n"))).otherwise(_of_language(F.col("ref_words"), F.col("ref_n"), lang))
    rows = rows.withColumn("word_distance", _distance(own, ref))
    odd = (F.col("n_words") >= MIN_WORDS) & ((F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE + WORD_SLACK / F.sqrt("n_words")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; and both distances.

    A null text has no words and fails the base rules. A null language, or one of fewer
    than MIN_TEXTS texts, is judged against all rows together. Repeated rows are judged each; other columns are ignored.
    """
    rows = judged(measured(docs, text_col, lang_col, F.col(id_col).cast("bigint").alias("doc_id")))
    return rows.select(
        "doc_id", "n_words", F.col("not_space").alias("word_chars"), (F.col("n_chars") - F.col("not_symbol")).alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "class_distance", "word_distance",
    )


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` that are kept, all columns, whatever their names.

    Null and short texts fail the base rules and go. A null or rare language is judged as in ``quality``; ids take no part, so
    that null or repeated ids are judged each by text and language. An empty table stays empty.
    """
    # The verdict hangs on text and language alone. Rejected rows are known by 128 bits of them and the id, so that no text is stored.
    parts = [F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), F.col(lang_col).cast("string")]
    keys = [F.xxhash64(*parts).alias("__a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("__b")]
    gone = materialize(judged(measured(docs, text_col, lang_col, *keys)).where("NOT kept").select("__a", "__b").distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_REJECTED else gone
    return docs.join(gone, (keys[0] == gone["__a"]) & (keys[1] == gone["__b"]), "left_anti")
