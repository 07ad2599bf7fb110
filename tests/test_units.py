"""Literal cases: coercion, extraction, pivots, search, chunks, citations, upserts, series, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import citations, coerce, extract, markup
from ledgerloom.operators.filters import apply_filters, not_true
from ledgerloom.operators.pivot import Metric, PivotSpec, column_values, grand_total, pivot
from ledgerloom.operators.search import analyzed, matches, parse_query
from ledgerloom.operators.series import backlog, movement
from ledgerloom.operators.upsert import partial_upsert
from ledgerloom.streaming.events import once, sessions, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_coercion(spark):
    s = lambda x: F.lit(x).cast("string")
    assert [one(spark, coerce.coerce_str(s(x))) for x in (' ="012" ', "nan", "NaT", "  ", None, " a ")] == ["012", None, None, None, None, "a"]
    assert [one(spark, coerce.coerce_num(s(x))) for x in ("1,000", "12.9", "-3", "x")] == [None, 12.9, -3.0, None]
    assert [one(spark, coerce.coerce_int(s(x))) for x in ("12.9", "-12.9")] == [12, -12]
    assert one(spark, coerce.coerce_date(s("1/4/2025"))) == datetime.date(2025, 1, 4)


def test_extraction(spark):
    assert one(spark, extract.docket(F.lit("Acme, 2024-PER-00123"))) == "2024-PER-00123"
    assert one(spark, extract.docket(F.lit("2006per20x 2006-ina-123456"))) == "2006-INA-123456"
    assert one(spark, extract.collapse(F.lit("  a   b  "))) == "a b"
    for said in ("Jan. 4, 2025", "Decision issued Jan. 4, 2025", "2025-01-04T10:00:00"):
        assert one(spark, extract.decision_date(F.lit(said))) == datetime.date(2025, 1, 4)
    outcome = lambda t: one(spark, extract.board_outcome(F.lit(t)))
    assert outcome("vacated and remanded") == "Remanded" and outcome("vacated " + "x " * 200 + "remanded") == "Reversed"
    assert outcome(" ") is None and outcome("affirmed. " + "y" * 2600) == "Affirmed" and outcome("nothing") == "Unknown"
    assert outcome("The motion for extension was not granted. The denial is affirmed.") == "Affirmed" and outcome("we remand; the denial is vacated") == "Remanded"
    assert outcome("administratively closed") == outcome("withdrawn") == "Dismissed" and outcome("It is ordered that labor certification is granted") == "Reversed"
    appeal = lambda t: one(spark, extract.appeals_outcome(F.lit(t)))
    assert appeal("this is unsustainable; the appeal is dismissed") == "Dismissed" and appeal("Dismissed, then SUSTAINED") == "Sustained" and appeal("none") is None
    assert one(spark, extract.form_number(F.lit("i-140.pdf"))) == "I-140" and one(spark, extract.form_number(F.lit("X-12.pdf"))) is None
    assert one(spark, extract.fiscal_year(F.lit("/d/FY2024_Q4/f.csv"))) == "FY2024" and one(spark, extract.fiscal_year(F.lit("/d/old/f.csv"))) == "old" and one(spark, extract.fiscal_year(F.lit("f.csv"))) is None
    assert one(spark, extract.safe_name(F.lit("PERM data: FY 2025/Q4"))) == "PERM_data_FY_2025_Q4"
    cell = lambda t: tuple(one(spark, c) for c in extract.priority_cell(F.lit(t)))
    assert cell("01JAN22") == (datetime.date(2022, 1, 1), False, False) and cell("01JAN85")[0].year == 1985
    assert cell("C") == (None, True, False) and cell("Unavailable") == (None, False, True) and cell("31FEB20")[0] is None and cell("-") == (None, False, False)
    assert one(spark, extract.form_number(F.lit("uscis_N_400_2024.pdf"))) == "N-400"
    assert [one(spark, extract.text_quality(F.lit(n), F.lit(1))) for n in (0, 100, 600, 5000)] == ["empty", "low_text", "short", "ok"]
    a, b = (extract.stable_id(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(u), F.lit(n)) for u, n in (("u1", "Acme"), ("u2", "Beta")))
    assert one(spark, a) != one(spark, b)


def test_citations():
    found = citations.find("See 25 l&N Dec. 369 and 25 I&N Dec. 369; 2006-per-20. Matter ofChawathe, 25 I&N Dec. 369\nend")
    assert [(k, c) for k, c, _ in found] == [("precedent", "25 I&N Dec. 369"), ("board", "2006-PER-20"), ("matter_of", "Matter of Chawathe")]
    assert [c for _, c, _ in citations.find("Matter oJSmith/Jones & Co., 3 I&N Dec. 4; MAR262026_01B6203; 25 1&N Dec. 3; Matter of Acme Corp.")] == ["3 I&N Dec. 4", "MAR262026_01B6203", "Matter of Smith/Jones & Co"]
    assert citations.find(None) == [] and "\n" not in found[0][2]


def test_citations_resolve(spark):
    found = spark.createDataFrame([(1, "board", "2006-PER-20"), (1, "appeals", "MAR262026_01B6203"), (2, "appeals", "MAR262026_01B6203"), (1, "appeals", "JAN012020_01B62030"), (1, "matter_of", "Matter of X Y")], "citing_id bigint, citation_type string, cited_raw string")
    known = spark.createDataFrame([("board", "2006-per-00020", 7), ("appeals", "MAR262026_01B6203", 1), ("appeals", "JAN012020_01B62030", 5), ("appeals", "JAN012020_01B62030", 6)], "citation_type string, key string, id bigint")
    got = {(r.citing_id, r.cited_raw): r.resolved_id for r in citations.resolve(found, known).collect()}
    assert got == {(1, "2006-PER-20"): None, (2, "MAR262026_01B6203"): 1, (1, "JAN012020_01B62030"): 6, (1, "Matter of X Y"): None}
    assert {r.resolved_id for r in citations.resolve(found, known, canonical=True).where("citation_type = 'board'").collect()} == {7}


def test_search_matches_against_words(spark):
    from ledgerloom.operators.search import analyzed, matches, parse_query, text_matches, tokens

    texts = ["er er", "Er, er", "erer", "from  ERING\n", "the catering from", "er x er", "", None, "der er er"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for text in ('"er er" OR "from ering"', "er -from", "catering OR der", "from ering", '"er er er"'):
        q = parse_query(text)

        def has(words, p):
            return any(tuple(words[i : i + len(p)]) == p for i in range(len(words)))

        want = {i for i, t in enumerate(texts) if all(has(tokens(t or ""), p) for p in q.all) and all(any(has(tokens(t or ""), p) for p in g) for g in q.any) and not any(has(tokens(t or ""), p) for p in q.none)}
        assert {r.i for r in rows.where(text_matches(F.col("t"), q)).collect()} == {r.i for r in rows.where(matches(analyzed(F.col("t")), q)).collect()} == want


def test_markup(spark):
    page = markup._parsed("<nav><p>no</p></nav><h2>T</h2><p>x<p>x<p>y <a href='/z'>go  on</a></p>")
    assert page.parts == ["T", "x", "y go on"] and page.links == [("/z", "go on")]


@pytest.fixture()
def cases(spark):
    return spark.createDataFrame([("a", "x", 1.0), ("a", None, 3.0), ("b", "y", None), (None, "x", 5.0)], "k string, c string, v double")


def test_pivot_rules(cases):
    out = {r.k: r.asDict() for r in pivot(cases, PivotSpec(("k",), (Metric("sum", "v", "s"), Metric("pct_of_total", None, "p")), column="c")).collect()}
    assert column_values(cases, "c") == ["x", "y", None] and out["a"]["None__s"] == 3.0 and out["a"]["x__p"] == 50.0 and out["a"]["__row_total__p"] == 50.0
    cells = grand_total(cases, PivotSpec(("k",), (Metric("avg", "v", "m"),), column="k", limit=2)).first().asDict()
    assert sum(n for c, n in cells.items() if c.endswith("__m") and not c.startswith("__")) == cells["n_rows"] == cases.count() and "__row_total__m" in cells
    total = grand_total(cases, PivotSpec(("k",), (Metric("avg", "v", "m"),), limit=2)).first()
    assert (total.m, total.n_groups, total.limited) == (3.0, 3, True)
    for bad in (PivotSpec(), PivotSpec(("zz",)), PivotSpec(("k",), (Metric("sum", "c"),)), PivotSpec(("k",), (Metric("median", "v"),)), PivotSpec(("k",), filters=(("k", "~", 1),))):
        with pytest.raises(ValueError):
            pivot(cases, bad)
    assert pivot(cases, PivotSpec(("k",), limit=9999)).count() == 3
    assert apply_filters(cases, [("c", "!=", "x")]).count() == 1 and apply_filters(cases, [("", "=", 1)]).count() == 4
    assert cases.where(not_true(F.col("v") > 2)).count() == 2


def test_search_language(spark):
    q = parse_query('"red fox" hen OR cock -dog the')
    assert q.all == (("red", "fox"),) and q.any == ((("hen",), ("cock",)),) and q.none == (("dog",),)
    docs = spark.createDataFrame([(1, "A red fox, a hen"), (2, "red big fox hen"), (3, "the RED fox and cock"), (4, "red fox hen dog"), (5, None)], "id int, t string")
    assert [r.id for r in docs.where(matches(analyzed(F.col("t")), q)).orderBy("id").collect()] == [1, 3]
    assert docs.where(matches(analyzed(F.col("t")), parse_query("the"))).count() == 0


def test_partial_upsert_keeps_a_null_that_came_last(spark):
    rows = spark.createDataFrame([(1, 1, "a", "p"), (1, 2, "b", None), (2, 1, None, "q")], "k int, seq int, base string, upd string")
    assert {tuple(r) for r in partial_upsert(rows, ["k"], ["seq"], ["base"], ["upd"]).collect()} == {(1, "a", None), (2, None, "q")}


def test_series_rules(spark):
    d = datetime.date
    rows = [("EB2", "IN", d(2024, m, 1), p, c) for m, p, c in ((1, d(2012, 1, 1), False), (2, None, True), (3, d(2012, 2, 1), False), (4, None, False), (5, d(2012, 3, 1), False))]
    series = spark.createDataFrame(rows, "preference string, chargeability string, bulletin_date date, priority_date date, is_current boolean")
    got = [r.movement_days for r in movement(series).orderBy("bulletin_date").collect()]
    assert got == [None, None, 31, None, None]
    b = backlog(series, F.lit("2024-03-01").cast("date")).first()
    assert b.priority_date == d(2012, 3, 1) and b.avg_advance == 30.0 and b.years_behind == 12.0


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=7 * i), i % 3, "click", float(i)) for i in range(50)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    batch.union(batch.limit(5)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(once(stream), "1 hour", None).writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert windowed_counts(once(batch), "1 hour").agg(F.sum("n")).first()[0] == 50
    assert sessions(batch, "10 minutes").count() == 50 and sessions(batch, "30 minutes").count() == 3
    assert query.exception() is None
