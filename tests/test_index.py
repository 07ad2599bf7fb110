"""The stored index, phrases, headlines and stems, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.stem import stem, stems
from ledgerloom.operators import inverted_index as I
from ledgerloom.operators.search import STOP_WORDS, best_window, bm25, finds, headline, highlight, mark_window, parse_query, text_matches, tokens
from ledgerloom.sources.scratch import folder

# Words and stems that the algorithm's publication gives.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formality": "formal",
    "triplicate": "triplic", "electricity": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "appeals": "appeal", "a1": "a1", "is": "is",
}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    rows = spark.createDataFrame([(w,) for w in [*STEMS, *STEMS]], "word string")
    assert {r.word: r.term for r in stems(rows).collect()} == STEMS


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["appeal", "appeals", "appealing", "the", "of", "story", "stories", "end", "ending", "visa", "visas", "denied", "to", "be", "alpha"]
    rows = [(i if i % 40 else None, None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(1, 4))), None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(n)]
    return rows + rows[:3]


def holds(text, phrase, analyse):
    words = [analyse(t) for t in tokens(text or "")]
    want = [analyse(t) if t else "" for t in phrase]
    return any(all(w in ("", x) for w, x in zip(want, words[i : i + len(want)])) and i + len(want) <= len(words) for i in range(len(words)))


@pytest.mark.parametrize("stemmed", [True, False])
def test_index_finds_what_reading_finds(spark, stemmed):
    rows, analyse = texts(1), stem if stemmed else str
    docs = spark.createDataFrame(rows, "id bigint, title string, body string").repartition(3)
    index = I.build(docs, "id", {"title": 1.0, "body": 0.1}, folder(spark, "t"), stemmed=stemmed, parts=4)
    for text in ("appeal", "appeals visa", '"end of the story"', '"end story"', "visa OR alpha", "denied -visa", '"the end of" -alpha', "to be", '"story to" OR "be visa"', "nosuchword", "", '"alpha the denied" visa'):
        q = parse_query(text)
        any_field = lambda r, p: any(holds(t, p, analyse) for t in r[1:])  # noqa: B023, E731
        want = [r for r in rows if (q.all or q.any) and all(any_field(r, p) for p in q.all) and all(any(any_field(r, p) for p in g) for g in q.any) and not any(any_field(r, p) for p in q.none)]
        found = I.matching(index, text).collect()
        assert sorted((r.id is None, r.id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in want), text
        top = I.search(index, text, 7).orderBy("rank").collect()
        assert [r.score for r in top] == sorted((r.score for r in found), reverse=True)[:7], text


def test_index_reads_the_parts_of_its_terms(spark):
    docs = spark.createDataFrame(texts(2), "id bigint, title string, body string")
    index = I.build(docs, "id", {"title": 1.0, "body": 0.1}, folder(spark, "t"), parts=6)
    plan = I.postings_of(index, ["visa"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan or "PartitionFilters: [isnotnull(part" in plan
    assert len(I.postings_of(index, ["visa"]).select("part").distinct().collect()) < index.postings.select("part").distinct().count()
    assert I.search(I.opened(spark, index.postings.inputFiles()[0].split("/postings/")[0]), "visa", 3).count() == 3


def test_index_of_nothing(spark):
    index = I.build(spark.createDataFrame([], "id bigint, body string"), "id", {"body": 1.0}, folder(spark, "t"))
    assert I.search(index, "word", 5).count() == 0 and I.matching(index, "word").count() == 0


def test_index_scores_are_bm25(spark):
    rows = [(i, b) for i, _, b in texts(3) if i is not None]
    docs = spark.createDataFrame(rows, "id bigint, body string")
    index = I.build(docs, "id", {"body": 1.0}, folder(spark, "t"), stemmed=False)
    want = {r.id: round(r.score, 6) for r in bm25(docs.dropDuplicates(["id"]), "id", "body", parse_query("visa denied")).collect()}
    index_of_once = I.build(docs.dropDuplicates(["id"]), "id", {"body": 1.0}, folder(spark, "t"), stemmed=False)
    assert {r.id: round(r.score, 6) for r in I.matching(index_of_once, "visa denied").collect()} == want and index.texts == len(rows)


def test_phrases_keep_the_places_of_stop_words(spark):
    rows = spark.createDataFrame([(1, "the end of the story"), (2, "end story"), (3, "End, of a story!"), (4, "to be"), (5, None), (6, "end of story")], "i int, t string")
    found = lambda q: sorted(r.i for r in rows.where(text_matches(F.col("t"), parse_query(q))).collect())
    assert found('"end of the story"') == [1, 3] and found('"end story"') == [2] and found('"the end"') == [1, 2, 3, 6] and found('"to be"') == [] and found('end -"end of the story"') == [2, 6]


def brute_window(hits, words, least, most):
    spans = [(a, b) for a in hits for b in hits if a <= b and b - a < most]
    if not spans:
        return (0, min(words, least) - 1)
    a, b = min(spans, key=lambda s: (-sum(s[0] <= h <= s[1] for h in hits), s[1] - s[0], s[0]))
    while b - a + 1 < least and b + 1 < words:
        b += 1
    while b - a + 1 < least and a > 0:
        a -= 1
    return a, b


def test_best_window_is_that_of_all_windows():
    rng = random.Random(6)
    for _ in range(3000):
        words = rng.randrange(1, 40)
        hits = sorted(rng.sample(range(words), rng.randrange(0, min(words, 9) + 1)))
        least = rng.randrange(1, 8)
        most = least + rng.randrange(0, 10)
        assert best_window(hits, words, least, most) == brute_window(hits, words, least, most), (hits, words, least, most)


def test_headlines(spark):
    q = parse_query("alpha beta")
    assert mark_window("alpha y y y y alpha beta, alpha beta y.", {"alpha", "beta"}, str, 2, 4) == "<mark>alpha</mark> <mark>beta</mark>, <mark>alpha</mark> <mark>beta</mark>"
    rows = spark.createDataFrame([("One appeal. Two appeals were dismissed here",), (None,), ("",), ("no hit at all",)], "t string")
    got = [r[0] for r in rows.select(headline(F.col("t"), parse_query("appealed"), 3, 5, stemmed=True)).collect()]
    assert got == ["<mark>appeal</mark>. Two <mark>appeals</mark>", None, "", "no hit at"]
    assert q.terms == ["alpha", "beta"]
    row = spark.createDataFrame([("The then Then .* x",)], "t string").select(highlight(F.col("t"), "the then of"), highlight(F.col("t"), "of"), finds(F.col("t"), "THEN"), finds(F.col("t"), ".*"), finds(F.col("t"), "zz")).first()
    assert tuple(row) == ("<mark>The</mark> <mark>then</mark> <mark>Then</mark> .* x", "The then Then .* x", [5, 10], [15], [])
    assert not STOP_WORDS & {"end", "story"} and re.fullmatch("[a-z ]+", " ".join(sorted(STOP_WORDS)))
