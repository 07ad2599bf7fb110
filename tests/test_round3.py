"""Queries on odd rows and on keys of larger tables, against their SQL or a plain version."""

import duckdb
import pytest

from ledgerloom.plans import registry

from .oracle import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def made(folder, name: str, sql: str) -> str:
    """A folder with one table more, made by DuckDB."""
    duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_dockets_of_long_numbers(spark, tmp_path):
    keys = (0, 1, 5, 899, 900, 99_899, 99_900, 123_456, 999_899, 999_900, 5_400_001)
    rows = ", ".join(f"({k}, 'Customer#{k:09d}')" for k in keys)
    sf_dir = made(tmp_path, "customer", f"SELECT c_custkey::BIGINT AS c_custkey, c_name FROM (VALUES {rows}, (7, NULL), (NULL, 'Nobody')) c(c_custkey, c_name)")
    same(QUERIES["docket_extract"](spark, sf_dir), connect(sf_dir), SQL["docket_extract"])


def test_dear_fields_are_named_once_and_spread(spark, tmp_path):
    """A small file is worked on by many tasks, and no expression of a letter holds the text's regular expressions over and over."""
    sf_dir = made(tmp_path, "orders", "SELECT i::BIGINT AS o_orderkey, (i % 7)::BIGINT AS o_custkey, TIMESTAMP '1996-03-01' + to_days((i % 900)::INT) AS o_orderdate FROM range(300) t(i)")
    made(tmp_path, "customer", "SELECT i::BIGINT AS c_custkey FROM range(300) t(i)")
    for name in ("experience_letters", "wage_forms", "bulletin_cells"):
        rows = QUERIES[name](spark, sf_dir)
        assert "RepartitionByExpression" in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) or "Repartition " in plan
        same(rows, connect(sf_dir), SQL[name])


def test_manuals_are_cut_like_a_walk_over_their_pages(spark):
    import random

    from ledgerloom.functions.manuals import split_manual

    random.seed(5)
    pages = [(f, p, f"Volume {random.choice('123')}, Part A – S\nx" if random.random() < 0.5 else "x") for f in (1, 2, 3) for p in range(400)]
    want = []
    for f in (1, 2, 3):
        label, held, sizes = None, 0, [0]
        for p, text in [(p, t) for g, p, t in pages if g == f]:
            now = text.split(" – ")[0].strip() if p > 5 and text.startswith("Volume") else None
            if now and label and now != label and held > 3:
                sizes.append(0)
                held = 0
            label, held, sizes[-1] = now or label, held + 1, sizes[-1] + 1
        want += [(f, i, n) for i, n in enumerate(sizes)]
    rows = split_manual(spark.createDataFrame(pages, "file int, page int, text string"))
    assert sorted((r.file, r.nth, r.page_count) for r in rows.collect()) == want
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["chunk_paragraphs", "html_text"])
def test_texts_go_to_python_in_small_batches(spark, name):
    from .oracle import DATA

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    assert QUERIES[name](spark, DATA).count() > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


@pytest.mark.parametrize("stemmed", [True, False])
def test_an_index_exchanges_little_more_than_its_texts(spark, tmp_path, stemmed):
    import random

    from ledgerloom.operators import inverted_index as I

    def shuffled() -> int:
        jvm = spark.sparkContext._jvm
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) + rng.choice(["", "s", "ing"]) for _ in range(3000)]
    texts = [(i if i % 50 else None, " ".join(words[int(3000 * rng.random() ** 2)] for _ in range(1500))) for i in range(400)]
    before = shuffled()
    index = I.build(spark.createDataFrame(texts, "id bigint, body string").repartition(3), "id", {"body": 1.0}, str(tmp_path / "index"), stemmed=stemmed, parts=8)
    assert index.texts == 400 and shuffled() - before < 6 * sum(len(t) for _, t in texts)
    assert index.postings.count() == index.postings.select("term", "block").distinct().count()
    found = I.matching(index, words[7]).collect()
    assert len(found) == sum(any(index.analyse(w) == index.analyse(words[7]) for w in t.split()) for _, t in texts)


def test_equal_spans_are_one_island_in_any_order(spark, monkeypatch):
    """Rows of equal start and end may come to the second window in another order than to the first."""
    from ledgerloom.functions.letters import months_of_experience

    frame = type(spark.range(1))
    add = frame.withColumn
    monkeypatch.setattr(frame, "withColumn", lambda rows, name, value: add(rows.coalesce(1).sortWithinPartitions("begins") if name == "island" else rows, name, value))
    spans = "(1, DATE '2000-01-01', DATE '2000-03-01'), (1, DATE '2001-01-01', DATE '2001-05-01'), (1, DATE '2001-01-01', DATE '2001-05-01'), (1, DATE '2001-01-01', DATE '2001-06-01')"
    got = months_of_experience(spark.sql(f"SELECT * FROM VALUES {spans} t(who, start, end)"), "who").collect()
    assert [(r.jobs, r.months) for r in got] == [(4, 7)]
