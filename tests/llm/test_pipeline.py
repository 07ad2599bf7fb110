"""run() against its stages redone by plain means, and the registry."""

import collections
import sys

import corpus_pipeline
from ledgerloom.llm import queries as Q
from ledgerloom.llm.quality import quality
from ledgerloom.llm.toxicity import toxicity

from ..oracle import DATA
from .test_ngram_join import brute


def test_pipeline_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    left = {r.doc_id for r in toxicity(docs, labels).where("predicted = 0").collect()}
    after = docs.where(docs.doc_id.isin(sorted(left)))
    left = {r.doc_id for r in quality(after).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in after.collect() if r.doc_id in left]
    left = {i for i, _, component in brute(rows, 5, 8, 10) if i == component}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == left
    seats = collections.Counter()
    for r in got:
        seats[r.sequence_id] += r.length
    assert max(seats.values()) <= 4096 and len(seats) <= -(-sum(seats.values()) // 4096) + 1


def test_pipeline_edges(spark, edge_docs, edge_rows, no_docs, tmp_path):
    """Null ids, texts and languages, repeated rows, long texts, and columns whose names clash with inner ones."""
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 20)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("edge", edge_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path / "edge"))
        assert docs.dtypes == before.dtypes and docs.count() <= before.count(), name
    calm = {(r.doc_id, r.predicted) for r in toxicity(edge_docs, labels).collect()}
    after = [r for r in edge_docs.collect() if (r.doc_id, 0) in calm]
    kept = {(r.doc_id, r.n_words) for r in quality(spark.createDataFrame(after, edge_docs.schema)).where("kept").collect()}
    left = [r for r in after if any(i == r.doc_id for i, _ in kept)]
    least = {i for i, _, component in brute([(r.doc_id, r.text) for r in left], 5, 8, 10) if i == component}
    got = corpus_pipeline.run(spark, str(tmp_path / "edge")).collect()
    assert {r.doc_id for r in got} == least and len({i for i, *_ in edge_rows}) > len(least) > 0


def test_stages_and_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    numbers = [int(n[2:].split("_")[0]) for n in Q.queries()]
    assert sorted(numbers) == list(range(1, 14))
    import __spark_entry__

    assert set(Q.queries()) | {"pipeline"} < set(__spark_entry__.queries())
    assert "corpus_pipeline" in sys.modules
