"""Ranked text search over postings: AND, OR, exclusion, phrases, weighted fields, BM25, cross-corpus union."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..sources.scratch import folder, kept
from .filters import like_any

# Words too common to search for.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


@dataclass(frozen=True)
class Query:
    """All of ``all`` (terms or phrases), at least one of each tuple in ``any``, none of ``none``. An empty word of a phrase stands for any one word."""

    all: tuple[tuple[str, ...], ...] = ()
    any: tuple[tuple[tuple[str, ...], ...], ...] = ()
    none: tuple[tuple[str, ...], ...] = field(default=())

    @property
    def terms(self) -> list[str]:
        groups = [*self.all, *(p for g in self.any for p in g), *self.none]
        return sorted({t for p in groups for t in p if t})


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _phrase(part: str) -> tuple[str, ...]:
    """The words of a part of a query. Stop words within a phrase keep their place, those at its ends go; of stop words alone nothing is left."""
    words = ["" if t in STOP_WORDS else t for t in tokens(part)]
    held = [i for i, t in enumerate(words) if t]
    return tuple(words[held[0] : held[-1] + 1]) if held else ()


def parse_query(text: str) -> Query:
    """Four forms: "a phrase", -excluded, x OR y, and all other words, which must all occur.

    Stop words aren't searched for; a phrase takes any word in the place of one, so it matches its own text.
    """
    parts = re.findall(r'-?"[^"]*"|\S+', text)
    must, either, none, i = [], [], [], 0
    while i < len(parts):
        part = parts[i]
        words = _phrase(part)
        if part == "OR" or not words:
            i += 1
            continue
        if part.startswith("-"):
            none.append(words)
            i += 1
            continue
        group = [words]
        while i + 2 < len(parts) and parts[i + 1] == "OR" and (more := _phrase(parts[i + 2])):
            group.append(more)
            i += 2
        if len(group) > 1:
            either.append(tuple(group))
        else:
            must.append(words)
        i += 1
    return Query(tuple(must), tuple(either), tuple(none))


def analyzed(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str, fields: dict[str, float], only: list[str] | None = None) -> DataFrame:
    """(id, field, weight, term, pos); ``only`` the query's terms, so that a scan sends on nothing else."""
    parts = []
    for name, weight in fields.items():
        rows = docs.select(F.col(id_col), F.lit(name).alias("field"), F.lit(weight).alias("weight"), F.posexplode(analyzed(F.col(name))).alias("pos", "term"))
        parts.append(rows.where(F.col("term").isin(only)) if only is not None else rows)
    return reduce(DataFrame.unionByName, parts)


def _padded(text: Column) -> Column:
    """The words of a text, each between blanks of its own, so that a term or phrase is a plain substring."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "  "), F.lit(" "))


def _said(phrase: tuple[str, ...]) -> str:
    return f" {'  '.join(phrase)} "


def _gapped(phrase: tuple[str, ...]) -> str:
    """The phrase as a pattern in which an empty word is any word."""
    return f" {'  '.join(t or '[a-z0-9]+' for t in phrase)} "


def _holds(words: Column, phrase: tuple[str, ...]) -> Column:
    return words.rlike(_gapped(phrase)) if "" in phrase else F.contains(words, F.lit(_said(phrase)))


def _satisfied(words: Column, q: Query) -> Column:
    tests = [_holds(words, p) for p in q.all]
    tests += [reduce(lambda a, b: a | b, (_holds(words, p) for p in group)) for group in q.any]
    tests += [~_holds(words, p) for p in q.none]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def matches(words: Column, q: Query) -> Column:
    """Whether the analyzed words of a text satisfy the query; evaluated within the scan, no shuffle."""
    return F.exists(F.array(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))), lambda w: _satisfied(w, q))


def text_matches(text: Column, q: Query) -> Column:
    """The same of the text itself, which is analysed once, whatever the query asks."""
    return F.exists(F.array(_padded(text)), lambda w: _satisfied(w, q))


def _times(words: Column, phrase: tuple[str, ...]) -> Column:
    """How often padded words hold a term or, without overlaps, a phrase."""
    if "" in phrase:
        return F.regexp_count(words, F.lit(_gapped(phrase))).cast("int")
    said = _said(phrase)
    return ((F.length(words) - F.length(F.replace(words, F.lit(said), F.lit("")))) / len(said)).cast("int")


def text_score(text: Column, q: Query, weight: float = 1.0) -> Column:
    """Weighted term frequency of the query's wanted terms, damped by the logarithm: a row's own score, without a pass over the corpus."""
    wanted = dict.fromkeys([*q.all, *(p for g in q.any for p in g)])
    total = lambda w: reduce(lambda a, c: a + c, (F.log1p(_times(w, p)) for p in wanted), F.lit(0.0))
    return weight * F.element_at(F.transform(F.array(_padded(text)), total), 1)


def weighted_score(fields: dict[str, float], q: Query) -> Column:
    """The sum of the fields' scores, each by its weight: a hit in a title counts for more than one in the text."""
    return reduce(lambda a, c: a + c, (text_score(F.col(name), q, weight) for name, weight in fields.items()))


def composite_rank(score: Column, share: float, boosts: dict[str, tuple[Column, float]], degrees: dict[str, tuple[Column, float]]) -> Column:
    """``share`` of a text score, what each boost that holds adds, and by weight the decimal logarithm of one and each degree."""
    out = share * score
    for holds, value in boosts.values():
        out = out + F.when(holds, F.lit(value)).otherwise(F.lit(0.0))
    for degree, weight in degrees.values():
        out = out + weight * F.log10(1 + F.coalesce(degree, F.lit(0)))
    return out


def match_or_like(text: Column, q: Query, term: str, *fields: Column) -> Column:
    """The text satisfies the query, or one of the other fields contains the term as it is."""
    return like_any(term, *fields) | text_matches(text, q)


def bm25(docs: DataFrame, id_col: str, text_col: str, q: Query, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, tf) of matching texts. What each text has of the query is a narrow table, from one pass over the texts; collection statistics
    are one row of its aggregates. For many queries over one corpus the stored index is cheaper."""
    terms = list(dict.fromkeys(t for p in [*q.all, *(x for g in q.any for x in g)] for t in p if t))

    def facts(w: Column) -> Column:
        words = F.length(F.replace(F.regexp_replace(w, "[a-z0-9]+", "x"), F.lit(" "), F.lit("")))
        return F.struct(words.alias("len"), _satisfied(w, q).alias("hit"), *(_times(w, (t,)).alias(f"tf_{t}") for t in terms))

    rows = docs.select(id_col, F.element_at(F.transform(F.array(_padded(F.col(text_col))), facts), 1).alias("f")).select(id_col, "f.*")
    rows = kept(rows, folder(docs.sparkSession, "facts"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf_{t}") > 0).alias(f"df_{t}") for t in terms))
    rows = rows.where("hit").join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for t in terms:
        idf = F.log(1 + (F.col("n") - F.col(f"df_{t}") + 0.5) / (F.col(f"df_{t}") + 0.5))
        score = score + idf * F.col(f"tf_{t}") * (k1 + 1) / (F.col(f"tf_{t}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    total = reduce(lambda a, c: a + c, (F.col(f"tf_{t}") for t in terms), F.lit(0))
    return rows.select(id_col, score.alias("score"), total.alias("tf"))


def best_window(hits: list[int], words: int, least: int, most: int) -> tuple[int, int]:
    """(first, last) word of the stretch to show: of those of up to ``most`` words from hit to hit, the one with most hits, of these the
    shortest, then the first. It is then widened to ``least`` words, to the right, at the text's end to the left."""
    best, low = None, 0
    for high, end in enumerate(hits):
        while end - hits[low] + 1 > most:
            low += 1
        key = (low - high, end - hits[low], hits[low])
        if best is None or key < best:
            best = key
    first, last = (best[2], best[2] + best[1]) if best else (0, -1)
    last = min(words - 1, max(last, first + least - 1))
    return max(0, min(first, last - least + 1)), last


def mark_window(text: str, terms: set[str], analyse, least: int = 15, most: int = 30) -> str:
    """The best stretch of a text as it is written, hits between <mark> and </mark>; its beginning where nothing hits; empty without words."""
    spans = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", text)]
    hits = [i for i, (a, b) in enumerate(spans) if analyse(text[a:b].lower()) in terms]
    first, last = best_window(hits, len(spans), least, most)
    if last < first:
        return ""
    held, out, at = set(hits), [], spans[first][0]
    for i in range(first, last + 1):
        a, b = spans[i]
        out += [text[at:a], f"<mark>{text[a:b]}</mark>" if i in held else text[a:b]]
        at = b
    return "".join(out)


def headline(text: Column, q: Query, least: int = 15, most: int = 30, stemmed: bool = False) -> Column:
    """The stretch of ``least`` to ``most`` words that covers most of the query's wanted terms, hits marked. For the rows of a page of
    results: one pass over each of their texts. Null for a null text."""
    wanted = {t for p in [*q.all, *(p for g in q.any for p in g)] for t in p if t}
    analyse = stem if stemmed else str
    terms = {analyse(t) for t in wanted}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mark_window(t, terms, analyse, least, most))

    return run(text)


def highlight(text: Column, query: str) -> Column:
    """Every occurrence, in any case, of a word of the query of more than two characters between <mark> and </mark>; of words that begin alike the longest."""
    terms = sorted({t for t in query.split() if len(t) > 2}, key=lambda t: (-len(t), t))
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, terms)) + ")", "<mark>$1</mark>") if terms else text


def finds(text: Column, needle: str) -> Column:
    """array<int>: the places, from 1, at which a text holds a string, in any case and without overlaps."""
    if not needle:
        return F.array().cast("array<int>")
    parts = F.split(F.lower(text), re.escape(needle.lower()), -1)
    before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p)) + (k - 1) * len(needle) + 1)
    return F.when(F.size(parts) > 1, before).otherwise(F.array().cast("array<int>"))
