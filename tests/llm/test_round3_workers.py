"""Python workers that an executor holds at once: one for each running task, all of one kind."""

import random

import public_tokenizers

from ledgerloom.llm import ngram_join
from ledgerloom.llm.common import join_apart
from ledgerloom.llm.packing import pack

from .conftest import prose


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_tested_and_joined_in_tasks_of_their_own(spark, monkeypatch):
    rng, seen = random.Random(3), []
    text = prose(rng, 200)
    rows = [(i, text + f" end{i}") for i in range(4)]

    def noted(edges, a, b):
        seen.append(plan(edges))
        return components(edges, a, b)

    components = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", noted)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k=3, num=8, den=10).collect()
    assert {r.component_id for r in got} == {0}
    assert seen and not any("MapInArrow" in p for p in seen)


def test_small_frames_need_no_python_in_executors(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(40)], "doc_id bigint, text string")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert "LogicalRDD" not in plan(packed) and packed.count() == 40
    assert pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0

    rows = spark.range(900).selectExpr("if(id < 600, null, id % 2) AS k", "id AS v").selectExpr("if(v < 300, 7L, k) AS k", "cast(v AS string) AS s", "v")
    facts = rows.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "cast(k AS string) AS name", "array(k) AS list")
    joined = join_apart(rows, facts, "k")
    assert "LogicalRDD" not in plan(joined)
    assert sorted((r.k, r.v, r.name, r.list, r.n) for r in joined.collect()) == sorted([(7, v, "7", [7], 300) for v in range(300)] + [(v % 2, v, str(v % 2), [v % 2], 150) for v in range(600, 900)])
