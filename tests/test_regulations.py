"""Regulation files, precedents, routing of queries, and graph sizes, by literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import regulations as R
from ledgerloom.operators import filters, graph, series


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_regulation_file(spark):
    assert tuple(one(spark, R.regulation_file(F.lit("8 CFR Part 274a (up to date as of 1-05-2025).pdf")))) == (8, "274a", datetime.date(2025, 1, 5), "DHS / USCIS", "Control of Employment of Aliens", "8 CFR Part 274a")
    assert tuple(one(spark, R.regulation_file(F.lit("notes.v2.pdf")))) == (None, None, None, None, None, "notes.v2")
    docs = spark.createDataFrame([(1, "§ 214.1 First\ntext § 214.2 Second\n§ 214.1 Again"), (2, None), (3, "")], "id int, text string")
    assert sorted(tuple(r) for r in R.section_index(docs, "id", "text").collect()) == [(1, "214.1", "First", 0), (1, "214.2", "Second", 1)]
    assert R.section_index(docs, "id", "text", within=16).count() == 1
    cite = lambda text: one(spark, R.chunk_citation(F.lit(text), F.lit(8), F.lit("8 CFR 214")))
    assert (cite("see § 214.2 here"), cite("none")) == ("8 CFR 214.2", "8 CFR 214")


def test_decisions(spark):
    head = "SUBJECT: Matter of Chawathe, Adopted Decision 2006-01 (AAO)\nPM-602-0001 January 11, 2006"
    assert tuple(one(spark, R.adopted_decision(F.lit(head), F.lit("a.pdf")))) == ("Chawathe", "2006-01", "PM-602-0001", 2006, "Adopted 2006-01")
    assert tuple(one(spark, R.adopted_decision(F.lit("nothing"), F.lit("a.pdf")))) == ("a.pdf", None, None, None, "Adopted a.pdf")
    assert tuple(one(spark, R.precedent_entry(F.lit("Matter of  CHAWATHE, 25 I&N Dec. 369 (AAO 2010)")))) == (25, "369", "25 I&N Dec. 369", "Matter of CHAWATHE", 2010, "AAO")
    assert one(spark, R.precedent_entry(F.lit("no citation"))) is None
    assert one(spark, R.precedent_keys(F.lit("25 I&N Dec. 369"), F.lit("adopted"), F.lit("2006-01"))) == ["25 I&N Dec. 369", "25 l&N Dec. 369", "Adopted Decision 2006-01", "Adopted\xa0Decision\xa02006-01"]
    rows = spark.createDataFrame([("decision", None, "x Notice of docketing, briefing schedule"), ("decision", "Affirmed", "notice of docketing, briefing schedule"), ("decision", None, None), (None, None, "")], "t string, o string, x string")
    assert [r[0] for r in rows.select(R.notice_tag(F.col("t"), F.col("o"), F.col("x"))).collect()] == ["docketing_notice", "decision", "decision", None]


@pytest.mark.parametrize(("text", "is_form"), [("I-140", True), ("n-400a", True), ("I140", False), ("ABCD-12", False), ("I-1", False)])
def test_form_queries(text, is_form):
    assert filters.is_form_query(text) is is_form


def test_filters_and_graphs(spark):
    df = spark.createDataFrame([(1, "50% off", "I-140"), (2, "500 off", None), (3, None, "x")], "id int, t string, f string")
    assert [r.id for r in df.where(filters.like_any("50%", F.col("t"), F.col("f"))).collect()] == [1]
    assert [r.id for r in df.where(filters.form_lookup("i-140", F.col("f"), F.col("t"))).collect()] == [1]
    assert [r.id for r in filters.first_by_priority(df, [F.col("t") == "none", F.col("f").isNotNull()], F.desc("id")).collect()] == [3]
    assert filters.first_by_priority(df, [F.col("t") == "none"]).count() == 0
    assert [r.id for r in filters.incremental(df, df.where("id = 1"), "id", F.col("t").isNotNull()).collect()] == [2]
    filled = series.forward_fill(df.withColumn("k", F.lit(1)), ["k"], ["id"], "f").orderBy("id")
    assert [r.f for r in filled.collect()] == ["I-140", "I-140", "x"]
    nodes, edges = graph.drawn(spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, 2), (3, 2), (9, 3), (1, 8)], "src int, dst int"))
    assert [(r.id, r.in_degree, r.radius) for r in nodes.orderBy("id").collect()] == [(1, 0, 10.0), (2, 2, 38.0), (3, 1, 24.0)]
    assert sorted(tuple(r) for r in edges.select("src", "dst").collect()) == [(1, 2), (3, 2)]
