import collections
import hashlib
import random
import re
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm.quality import drop_low_quality, quality
from ledgerloom.llm.syncmers import edited_fingerprints, fingerprint, fingerprints, likeness, sketch
from ledgerloom.llm.toxicity import drop_toxic, ngrams, toxicity

from .conftest import prose


def base_rules(text):
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_edges(edge_docs, edge_rows, no_docs):
    got = quality(edge_docs).collect()
    found = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == collections.Counter((i, *base_rules(t or "")) for i, t, *_ in edge_rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality(no_docs).count() == 0
    kept = drop_low_quality(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_quality_divergence(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 150), "en") for i in range(60)]
    rows += [(100, prose(rng, 150).upper() + "!!", "en"), (101, prose(rng, 150).replace(" ", "&&& "), "en")]
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect() if not r.base_failed}
    assert all(kept[i] for i in range(60) if i in kept) and len(kept) > 50
    assert not kept.get(100) and not kept.get(101)


def test_quality_of_every_language(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(100 * n + i, prose(rng, 120), f"l{n:02}") for n in range(70) for i in range(22 if n < 69 else 21)]
    rows += [(7000 + i, prose(rng, 120), [None, "rare"][i % 2]) for i in range(10)]
    odd = [(8000, "l69"), (8001, None), (8002, "rare"), (8003, "l00")]
    rows += [(i, prose(rng, 120).replace(" ", "&&& "), lang) for i, lang in odd]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").cache()
    got = {r.doc_id: r for r in quality(docs).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {i for i, _ in odd}
    assert all(r.class_distance is not None and r.word_distance is not None for r in got.values())
    monkeypatch.setattr("ledgerloom.llm.quality.BROADCAST_LANGUAGES", 3)
    same = {r.doc_id: r for r in quality(docs).collect()}
    assert all(same[i].kept == r.kept and abs(same[i].class_distance - r.class_distance) + abs(same[i].word_distance - r.word_distance) < 1e-9 for i, r in got.items()) and len(same) == len(got)


def test_fingerprint_edges(edge_docs, edge_rows, no_docs):
    got = edited_fingerprints(edge_docs).collect()
    order = sorted(edge_rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = collections.Counter()
    for n, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_id = {r.doc_id: r.fingerprint for r in got}
    assert by_id[0] == by_id[1] != by_id[4] and by_id[6] == by_id[7]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {(r.doc_id, r.fingerprint) for r in fingerprints(edge_docs).collect()} == {(r.doc_id, r.fingerprint) for r in got}
    assert edited_fingerprints(no_docs).count() == 0


def chained(*values):
    """Spark's xxhash64 of strings or longs."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, seed=h % 2**64)
        h = h - 2**64 if h >= 2**63 else h
    return h


def brute_anchors(text, k=5, s=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes, out = [chained(w) for w in [""] * (k - 1) + words + [""] * (k - 1)], []
    for i in range(len(hashes) - k + 1 if words else 0):
        inner = [chained(*hashes[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner[0], inner[-1]) <= min(inner):
            out.append((i, chained(*hashes[i : i + k]) % 2**64 >> 24))
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    first, second = ({h: p for p, h in reversed(x)} for x in (a, b))
    both = sorted(set(first) & set(second), key=first.get)
    if not both:
        return 0.0
    rank = {h: r for r, h in enumerate(sorted(both, key=second.get))}
    return len(both) / len(set(first) | set(second)) * (1 - 2 * sum(abs(i - rank[h]) for i, h in enumerate(both)) / len(both) ** 2)


def test_fingerprints_are_all_anchors_with_their_positions(spark):
    rng = random.Random(8)
    base = [prose(rng, 100) for _ in range(20)]
    texts = ["", " \n", "one", "one two", "é ü 漢字 z", prose(rng, 31), prose(rng, 32), " ".join(base), " ".join(reversed(base)), " ".join([*base[1:], base[0]]), " ".join(base[:10] + ["put in here"] + base[10:]), "a b c " * 50, "a b c " * 49]
    pairs = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in texts for y in texts)]
    got = spark.createDataFrame(pairs, "i int, x string, y string").select("i", fingerprint(sketch(F.col("x"))).alias("f"), likeness(sketch(F.col("x")), sketch(F.col("y"))).alias("near")).collect()
    for r in got:
        a, b = brute_anchors(pairs[r.i][1]), brute_anchors(pairs[r.i][2])
        assert [(int(r.f[j], 16), int(r.f[j + 1 : j + 11], 16)) for j in range(0, len(r.f), 11)] == [(p - (a[n - 1][0] if n else 0), h) for n, (p, h) in enumerate(a)]
        assert abs(r.near - brute_likeness(a, b)) < 1e-9
        assert all(q - p < 5 for (p, _), (q, _) in zip(a, a[1:])) and bool(a) == bool(pairs[r.i][1].strip())
    near = {(pairs[r.i][1], pairs[r.i][2]): r.near for r in got}
    whole, reverse, turned, longer = texts[7:11]
    assert near[whole, reverse] < 0.2 and 0.7 < near[whole, turned] < 0.95 < near[whole, longer] < 1


def test_fingerprint_rows_without_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr("ledgerloom.llm.syncmers.BUCKET_ROWS", 20)
    rng = random.Random(9)
    rows = [(None if i % 3 else i, prose(rng, 12)) for i in range(900)]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), chained(r[1]) >> 1))
    want = collections.Counter()
    for n, (i, text) in enumerate(order):
        after, half = order[(n + 1) % len(order)][1], len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_fingerprint_likeness_and_many_buckets(spark):
    rng = random.Random(4)
    rows = [(i * i, prose(rng, 20 + i % 90)) for i in range(5000)]
    got = {r.doc_id: r for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()}
    ids, text = sorted(got, reverse=True), dict(rows)
    for n, i in enumerate(ids):
        a, b = text[i], text[ids[(n + 1) % len(ids)]]
        assert got[i].edited_sha256 == hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    near = sorted(r.near_edited for r in got.values())
    assert near[250] > 0.1 and sorted(r.near_next for r in got.values())[-250] < 0.1


def test_toxicity_learns_and_holds_out(spark, edge_docs, no_docs):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        words, toxic = prose(rng, 80).split(), i % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(80), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, known).collect()}
    assert len(got) == 400
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == int(i % 8 == 0) == int(r.score >= 0.3)
    kept = drop_toxic(docs, known)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 8]
    edge = toxicity(edge_docs, known).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert len({r.score for r in edge if r.doc_id in (6, 7)}) == 1
    assert toxicity(no_docs, known).count() == 0
    assert {r.score for r in toxicity(edge_docs, known.limit(0)).collect()} and ngrams("").size == 0


def test_scores_do_not_use_other_columns(spark):
    rows = [(i, "some plain words here" if i % 2 else "you idiot and moron", i % 2) for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang int")
    a = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity(docs.withColumn("lang", F.lit(0)), labels).collect()}
    assert a == b
