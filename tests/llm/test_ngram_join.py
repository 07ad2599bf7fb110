import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import shingles as module
from ledgerloom.llm.common import join_apart, slices, text_bytes
from ledgerloom.llm.components import components, stars
from ledgerloom.llm.ngram_join import CountTree, Router, _nearest, bound, count_vector, jaccard_components, keep_one_of_each_group, overlap_needed, pack_vector, unpack_vector
from ledgerloom.llm.shingles import shingle_sets, word_hashes


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_word_hashes_do_not_hang_on_blocks(monkeypatch):
    texts = pa.array(["one two  three", "", "x" * 50 + " two", " three\tone\n", "two"])
    whole = shingle_sets(texts, 2), word_hashes(*text_bytes(texts))
    for block in (1, 7, 20):
        monkeypatch.setattr(module, "BLOCK", block)
        sets, (hashes, where) = shingle_sets(texts, 2), word_hashes(*text_bytes(texts))
        assert all(np.array_equal(a, b) for a, b in zip(whole[0], sets, strict=True))
        assert np.array_equal(whole[1][0], hashes) and where.tolist() == whole[1][1].tolist() == [0, 0, 0, 2, 2, 3, 3, 4]


def test_slices_count_all_named_texts():
    batch = pa.RecordBatch.from_pydict({"x": ["aaaa", "a", "a", "aaaaaaaa"], "y": ["aaaa", "a", "aaa", ""]})
    assert [b.num_rows for b in slices([batch], "x", "y", limit=6)] == [1, 2, 1]


def brute(rows, k, num, den):
    """{doc_id: (set size of each row, component)} by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def near_texts(seed=3):
    """Families of texts with edits around the threshold, long and short."""
    rng, rows, i = random.Random(seed), [], 0
    for size in (3, 5, 8, 12, 25, 60, 150, 400):
        for _ in range(3):
            base = [f"w{rng.randrange(900)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, size // 40 + 1, size // 25 + 1, size // 15 + 1):
                words = list(base)
                for _ in range(min(edits, size)):
                    at = rng.randrange(len(words))
                    words[at : at + rng.randrange(2)] = [f"n{rng.randrange(900)}"]
                rows.append((i, " ".join(words)))
                i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_near_copies_against_all_pairs(spark, k, num, den):
    rows = near_texts()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), k=k, num=num, den=den).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, num, den)


def test_edges(edge_docs, edge_rows):
    got = jaccard_components(edge_docs, k=3, num=90, den=100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([r[:2] for r in edge_rows], 3, 90, 100)


def test_large_group_of_near_copies_needs_tiles(spark, monkeypatch):
    rng = random.Random(1)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr("ledgerloom.llm.ngram_join.TILE", 16)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k=3, num=8, den=10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 3, 8, 10)


def test_empty_table_and_pipeline_stage(no_docs, edge_docs):
    assert jaccard_components(no_docs).count() == 0
    kept = keep_one_of_each_group(edge_docs, k=3, num=9, den=10)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 0 in ids and 1 not in ids and 6 in ids and 7 in ids and ids.count(4) == 2
    clash = edge_docs.withColumnRenamed("lang", "__gone")
    assert keep_one_of_each_group(clash, k=3, num=9, den=10).count() == len(ids) and keep_one_of_each_group(no_docs).count() == 0


def test_router_never_loses_a_link():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (8, 10)):
        router = Router(num, den)
        for size in (1, 2, 3, 5, 9, 10, 17, 40, 200, 1500):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                drop = rng.integers(0, max(1, len(a) * (den - num) // den + 1))
                add = rng.integers(0, 3)
                b = np.unique(np.concatenate([rng.choice(a, len(a) - drop, replace=False), rng.integers(0, 2**63, add, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and den * both >= num * (len(a) + len(b) - both):
                    assert np.intersect1d(router.keys(a), router.keys(b)).size


def test_tree_bounds_are_never_below_the_overlap():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200), dtype=np.uint64)) for _ in range(70)]
    tree = CountTree(np.array([count_vector(s, 64) for s in sets]))
    for s in sets:
        found = set(tree.search(count_vector(s, 64), 5, 10)[0].tolist())
        for i, t in enumerate(sets):
            if len(np.intersect1d(s, t)) >= overlap_needed(len(s), len(t), 5, 10):
                assert i in found


def test_vectors_bound_the_overlap_over_any_groups():
    rng = np.random.default_rng(3)
    for size in (0, 1, 70, 300, 5000, 20_000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size // 3], rng.integers(0, 2**63, size // 2 + 1, dtype=np.uint64)]))
        v, w = (unpack_vector(pack_vector(count_vector(s)), len(s)) for s in (a, b))
        assert v.sum() == len(a) and w.sum() == len(b) and len(np.intersect1d(a, b)) <= bound(v, w)
    heavy = np.full(300, 64, np.uint64) * np.arange(300, dtype=np.uint64) * np.uint64(8192)
    assert unpack_vector(pack_vector(count_vector(heavy)), 300).tolist() == count_vector(heavy).tolist()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(None, 3), (5, 5), (8, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert all(found[i] == 100 for i in range(100, 141)) and all(found[i] == 7 for i in [7, 8, *range(20, 60)])
    assert 5 not in found and None not in found


@pytest.mark.parametrize("hot", [1, 2])
def test_hot_keys_are_joined_apart(spark, monkeypatch, hot):
    monkeypatch.setattr("ledgerloom.llm.common.HOT_KEYS", hot)
    monkeypatch.setattr("ledgerloom.llm.common.HOT_ROWS", 2)
    rows = [(i, f"text number {i % 4} of a class of copies") for i in range(20)] + [(20, "alone here it stands"), (21, None)]
    rows += [(30 + i, " ".join([*(f"w{j}" for j in range(60)), f"end{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert found == sorted(brute(rows, 3, 9, 10))
    facts = spark.createDataFrame([(1, 5, "a"), (2, 4, "b"), (3, 1, "c")], "k int, n int, f string")
    many = spark.createDataFrame([(1,)] * 5 + [(2,)] * 4 + [(3,), (4,), (None,)], "k int")
    assert sorted(r.f for r in join_apart(many, facts, "k").collect()) == list("aaaaabbbbc")


def test_trees_reach_a_linked_partner_of_every_text(tmp_path):
    rows = [(i, t) for i, t in near_texts(5)]
    sets = dict(zip([i for i, _ in rows], shingle_sets(pa.array([t for _, t in rows]), 3), strict=True))
    nodes = sorted(sets)
    batch = pa.RecordBatch.from_pydict({"lead": [0] * len(nodes), "chunk": [0] * len(nodes), "node": nodes, "size": [len(sets[i]) for i in nodes], "vector": [pack_vector(count_vector(sets[i])) for i in nodes]})
    found = [r for out in _nearest(9, 10)(iter([batch.slice(0, 50), batch.slice(50)])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    partners = {}
    for a, b, like in found:
        partners.setdefault(a, []).append((like, b))
        both = len(np.intersect1d(sets[a], sets[b]))
        assert like >= both / (len(sets[a]) + len(sets[b]) - both) - 1e-12
    order = sorted(nodes, key=lambda i: (i != 0, len(sets[i]), i))
    linked_ones = 0
    for n, i in enumerate(order):
        if any(10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j])) for j in order[:n]):
            linked_ones += 1
            assert partners[i]
    assert linked_ones > 50


def test_an_id_with_several_texts_links_by_each(spark):
    rng = random.Random(8)
    w, v = ([f"{tag}{rng.randrange(10**6)}" for _ in range(201)] for tag in "wv")
    near = [*v[:100], "other", *v[101:]]
    rows = [(2, " ".join(w)), (7, " ".join(w)), (7, " ".join(v)), (9, " ".join(near)), (11, "alone here now"), (7, ""), (4, "  "), (4, "x y z"), (5, "x y z"), (5, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_components(docs, k=3, num=9, den=10).collect()), key=repr)
    assert got == brute(rows, 3, 9, 10)
    assert {i: c for i, _, c in got} == {2: 2, 7: 2, 9: 2, 11: 11, 4: 4, 5: 4}


def test_a_hot_id_with_many_texts(spark):
    """A third of all rows share one id, each with a text of its own."""
    rng = random.Random(9)
    texts = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    rows = [(50, t) for t in texts] + [(1000 + i, texts[i % 400]) for i in range(0, 800, 3)] + [(3, texts[0]), (2000, "far away from all")]
    got = {i: c for i, _, c in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k=3, num=9, den=10).collect()}
    assert {c for i, c in got.items() if i != 2000} == {3} and got[2000] == 2000


def test_stars_keep_components():
    rng = random.Random(4)
    for _ in range(50):
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 40))]
        u, v = stars(*(np.array(x, np.int64) for x in zip(*edges)))
        root = {x: x for e in edges for x in e}
        for _ in range(40):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert dict(zip(u.tolist(), v.tolist())) == {x: r for x, r in root.items() if x != r}
