"""Discovery, resumed merges, vector lists, mixed graphs and the stateful stream, by literals and against batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, vector_index
from ledgerloom.operators.resume import Target, merge, merged_crawl
from ledgerloom.sources import site_links
from ledgerloom.sources.scratch import folder
from ledgerloom.streaming import activity


def pages(spark, *rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_bulletin_links(spark):
    html = "<a href='/v/visa-bulletin-for-may-2024.html'> May <b>2024</b></a><a href='/v/visa-bulletin-for-may-2024.html'>again</a><a href='https://y.example/visa-bulletin-for-june-2023.html'>June</a><a href='/visa-bulletin-for-mai-2024'>no month</a><a href='/visa-bulletin-for-july-2024'></a><a>none</a>"
    got = site_links.bulletin_links(pages(spark, ("https://x.example/i", html), ("u", None))).orderBy("month").collect()
    assert [(r.url, r.label, r.month) for r in got] == [("https://y.example/visa-bulletin-for-june-2023.html", "June", datetime.date(2023, 6, 1)), ("https://x.example/v/visa-bulletin-for-may-2024.html", "May 2024", datetime.date(2024, 5, 1))]


def test_precedent_links(spark):
    html = """<body><main><h2>Volume 29</h2><p><b>Matter of ROE,</b> 29 I&amp;N Dec. 12 (BIA 2025) <a href='/media/1'>pdf</a></p><p>29 I&amp;N Dec. 12 <a href='/x.pdf'>twice</a></p>
      <p>DOE, 28 I&amp;N Dec. 7 (A.G. 2024)<a href='other'>no file</a><a href='/y.pdf'>f</a></p><p>29 I&amp;N Dec. 99 without a link</p><p><a href='/z.pdf'>no citation</a></p></main></body>"""
    got = site_links.precedent_links(pages(spark, ("https://x.example/", html), ("v", ""))).orderBy("position").collect()
    assert [(r.url, r.party, r.citation, r.volume, r.year, r.body) for r in got] == [
        ("https://x.example/media/1", "Matter of ROE", "29 I&N Dec. 12", 29, 2025, "BIA"), ("https://x.example/y.pdf", "DOE", "28 I&N Dec. 7", 29, 2024, "A.G.")]


def test_sheet_links(spark):
    html = """<details><summary>FY2025 Quarter 4</summary><a href='a b.xlsx'>Forms, all</a><a href='n.html'>no</a></details><section><h3>FY2024 Q4</h3><a href='old.csv'>old</a></section>
      <div>Data of July 2025 <a href='/q.zip'></a></div><li>2025<a href='r.csv'>report</a></li>"""
    got = site_links.sheet_links(pages(spark, ("https://x.example/d/", html)), ("2025", "fy2025"), ("quarter 4", "q4", "july")).orderBy("position").collect()
    assert [(r.url, r.label, r.filename) for r in got] == [("https://x.example/d/a b.xlsx", "Forms, all", "Forms_all.xlsx"), ("https://x.example/q.zip", "q.zip", "q.zip")]


def test_statutes_through_parts(spark):
    part = "/uscode/text/8/chapter-12/subchapter-II/part-"
    a = f"<nav><li><a href='/uscode/text/8/9'>chrome</a></li></nav><div id='content'><ul><li>x<a href='{part}A'>A</a><li><a href='{part}B'>B</a></li><li><a href='{part}gone'>C</a></ul></div>"
    b = f"<main><li><a href='{part}A/1'>deeper</a></li><li><a href='{part}A'>back to itself</a></li></main>"
    deep = "<main><ul><li><a href='/uscode/text/8/1101'>§ 1101. Definitions</a></li><li><a href='/uscode/text/8/1102/'>§ 1102a. More</a></li></ul></main>"
    last = "<li><a href='/uscode/text/8/1101'>again</a></li><li><a href='/other'>no</a></li><li><a href='/uscode/text/8/1200'>Last</a></li>"
    site = "https://x.example"
    table = pages(spark, (f"{site}/i", a), (f"{site}{part}A", b), (f"{site}{part}A/1", deep), (f"{site}{part}B", last), (f"{site}/unrelated", last))
    got = site_links.statute_sections(table, spark.createDataFrame([(f"{site}/i",), (f"{site}/missing",)], "url string"))
    assert [(r.section, r.title, r.trail) for r in got.orderBy("trail").collect()] == [("1101", "Definitions", [0, 0, 0]), ("1102", "More", [0, 0, 1]), ("1200", "Last", [1, 1])]
    assert site_links.statute_sections(table, spark.createDataFrame([], "url string")).count() == 0


def test_broken_batches_are_made_again(spark):
    source = spark.createDataFrame([(i, i // 3) for i in range(10)], "k int, b int")
    schema, calls = "k int, made string", []

    def make(rows, fail=None):
        calls.append(1)
        at = rows.select("b").first()[0]
        if at == fail:
            raise RuntimeError("broken off")
        return rows.select("k", F.concat(F.lit("m"), F.col("k").cast("string")).alias("made"))

    broken = Target(spark, folder(spark, "a"), schema, "k")
    with pytest.raises(RuntimeError):
        merge(broken, source, "b", lambda rows: make(rows, 2), "one")
    assert broken.rows().count() == 6
    # What a run left without a status is not read.
    source.where("b = 3").select("k", F.lit("half").alias("made")).write.parquet(f"{broken.path}/batches/attempt=lost/batch=9")
    with pytest.raises(RuntimeError):
        merge(broken, source, "b", lambda rows: make(rows, 3), "two")
    assert merge(broken, source, "b", make, "three") == 1 and merge(broken, source, "b", make, "four") == 0
    whole = Target(spark, folder(spark, "b"), schema, "k")
    merge(whole, source, "b", make, "only")
    assert sorted(broken.rows().collect()) == sorted(whole.rows().collect()) and whole.rows().count() == 10
    assert broken.status().count() == 4 and Target(spark, folder(spark, "c"), schema, "k").rows().count() == 0


def test_crawls_merge_in_order(spark):
    row = "sub string, section string, text string, place int"
    fetched = spark.createDataFrame([("II", "2", "new", 1), ("II", "2", "again", 2), ("I", "1", "new", 0)], row)
    prior = spark.createDataFrame([("II", "2", "old", 1), ("II", "3", "kept", 2), ("III", "7", "whole", 0), ("X", "9", "unranked", 0)], row)
    groups = spark.createDataFrame([("I", 0), ("II", 1), ("III", 2)], "sub string, rank int")
    got = merged_crawl(fetched, prior, groups, "sub", "section", "place").collect()
    assert [(r["sub"], r.section, r.text) for r in got] == [("I", "1", "new"), ("II", "2", "new"), ("II", "3", "kept"), ("III", "7", "whole"), ("X", "9", "unranked")]


def test_vector_lists(spark):
    rows = [(i, [float((i * 37 + j * 11) % 23 - 11) for j in range(8)]) for i in range(300)] + [(900, None), (901, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "id int, v array<double>")
    index = vector_index.build(vectors, "id", "v", folder(spark, "v"), lists=6)
    assert index.rows.count() == 301 and "PartitionFilters: [list" in vector_index.nearest(index, rows[5][1], 3, probe=2)._jdf.queryExecution().executedPlan().toString().replace("isnotnull(list#", "list#")
    asked = spark.createDataFrame([r for r in rows if r[0] % 100 == 0 and r[1]], "id int, vector array<double>")
    exact, some = (vector_index.recall(index, asked, 10, p).agg(F.avg("recall")).first()[0] for p in (6, 3))
    assert exact == 1.0 and 0.5 < some <= 1.0
    best = vector_index.nearest(index, rows[7][1], 3, probe=6).collect()
    assert best[0].similarity == 1.0 and len(best) == 3


def test_mixed_graph_keeps_its_classes(spark):
    edges = spark.createDataFrame([(1, 100), (1, 200), (2, 201), (2, 1), (3, 200), (3, 202), (9, 100), (1, 300), (2, 300), (3, 301), (1, 302), (2, 302), (1, 303), (3, 303)], "src int, dst int")
    seeds = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id int, rank double")
    kinds = spark.createDataFrame([(i, "precedent" if i < 300 else "other") for i in (100, 200, 201, 202, 300, 301, 302, 303)], "id int, kind string")
    nodes, kept = graph.around(edges, seeds, kinds, {"precedent": 3, "other": 15}, always=("precedent",))
    assert sorted((r.id, r.degree) for r in nodes.where("tier = 'secondary'").collect()) == [(100, 1), (200, 2), (201, 1), (300, 2), (302, 2), (303, 2)]
    assert sorted((r.src, r.dst) for r in kept.collect()) == [(1, 100), (1, 200), (1, 300), (1, 302), (1, 303), (2, 1), (2, 201), (2, 300), (2, 302), (3, 200), (3, 303)]
    none, no_edges = graph.around(edges, seeds.where("id > 50"), kinds, {"precedent": 3})
    assert none.count() == no_edges.count() == 0
    ranked = spark.createDataFrame([(200, 0.0), (300, 0.0), (5, 0.1)], "id int, score double")
    assert [r.id for r in graph.seeds_of(ranked, edges, 2).collect()] == [200, 300]


def test_stream_of_overlapping_loads_equals_the_batch(spark, tmp_path):
    """Loads that repeat rows and bring late ones, replayed; a row behind the overlap is let go."""
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(hours=5 * i), ["a", "b", None][i % 3], None if i % 7 == 0 else float(i)) for i in range(60)]
    schema, there = "event_id bigint, ts timestamp, kind string, value double", str(tmp_path / "in")
    late = [rows[1], rows[3], rows[20]]
    for load in (rows[:30], rows[10:45], late + rows[40:], rows[25:]):
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(there)
    stale = (777, base - datetime.timedelta(days=60), "a", 5.0)
    spark.createDataFrame([stale, rows[59]], schema).coalesce(1).write.mode("append").parquet(there)
    before = {k: spark.conf.get(k, None) for k in (activity.PROVIDER[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*activity.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = []
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(there)
        out = activity.running(stream, "kind", "event_id", "ts", "value", overlap_days=20)
        run = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, n: got.extend(df.collect())).start()
        run.awaitTermination(240)
        assert run.exception() is None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {r.key: tuple(r) for r in activity.once_over(spark.createDataFrame(rows, schema), "kind", "event_id", "ts", "value").collect()}
    assert {r.key: tuple(r) for r in got} == want and set(want) == {"a", "b"}


def test_section_text_by_content_root(spark):
    html = """<header><p>site</p></header><div class='sidebar x'><p>side</p></div><main><p>outside of the content</p></main>
      <div id='content'><nav><li>menu</li></nav><h2>§ 1101. Title</h2><p>First  para.</p><ul><li><p>nested item</p></li><li>ab</li></ul><div class='tabs'><p>tab</p></div></div><div id='tab_default_2'>Some <b>notes</b></div>"""
    got = site_links.section_texts(pages(spark, ("a", html), ("b", "<p>only this</p><p>only this</p>"), ("c", None), ("d", "<div class='field-item even'><p>field text</p></div><p>no</p>"))).orderBy("page").collect()
    assert [(r.text, r.notes) for r in got] == [("§ 1101. Title\n\nFirst para.\n\nnested item", "Some notes"), ("only this", ""), ("", ""), ("field text", "")]


def test_writers(spark, tmp_path):
    from ledgerloom.operators.filters import clean_query, filters_used
    from ledgerloom.sources import sinks

    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", "x")], "n int, t string, k string")
    for _ in range(2):
        sinks.write_json(df, str(tmp_path / "j"))
        sinks.write_text(df, str(tmp_path / "t"), "t", "k")
    assert sorted(tuple(r) for r in spark.read.schema("n int, t string, k string").json(str(tmp_path / "j")).collect()) == [(1, "a", "x"), (2, None, "y"), (3, "c", "x")]
    assert sorted((r.value, r.k) for r in spark.read.text(str(tmp_path / "t")).collect()) == [("a", "x"), ("c", "x")]
    assert clean_query("  a \n b ") == "a b" and clean_query(None) == "" and filters_used(a=None, b="", c=False, d=0.5, e="x") == {"d": 0.5, "e": "x"}
