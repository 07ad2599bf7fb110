"""Operators 11 to 13 against brute force and the library."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import backtracking, collocations, term_matrix
from ledgerloom.llm.backtracking import MergePieces, merge_pieces, unit_pattern
from ledgerloom.llm.queries import oracle_sql, queries

from ..oracle import DATA, connect, same

PIECE = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*" \n\t'abcABC.,1é漢▁", "<s>", "<0x0A>", " the", "   ", "ing ", "tion", "\x00", "https://", "=====", "  ", "’s", "…”"])), max_size=60).map("".join)


@pytest.fixture(scope="module")
def pieces():
    return merge_pieces(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)


# --- 13 ---


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_the_library_s(pieces, text):
    code, library = pieces
    ids = library.encode(text)
    assert code.encode(text) == ids
    assert code.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.sampled_from([0, 1, 2, 3, 13, 28705, 264, 3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 0xFF])), max_size=12))
def test_any_ids_decode_as_the_library_s(pieces, ids):
    code, library = pieces
    assert code.decode(ids) == library.decode(ids)


def test_long_runs_without_a_cut(pieces):
    code, library = pieces
    rng = random.Random(4)
    for text in ("ab" * 30_000, "漢字かな交じり文" * 3000, "=-" * 9000 + "x", "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 5000 + "a"):
        assert code.encode(text) == library.encode(text)


def test_backtracking_is_merging_for_any_vocabulary():
    """Small vocabularies in which the longest match is often wrong, with equal scores, unreachable pieces and unknown characters."""
    rng, back = random.Random(7), 0
    for _ in range(400):
        longer = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 14))}
        names = sorted(longer | set(rng.sample("abc", rng.randrange(1, 4))))
        vocabulary = {p: (n, float(-rng.randrange(6))) for n, p in enumerate(names)}
        code = MergePieces(vocabulary, list(range(100, 356)), {})
        for _ in range(25):
            unit = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))
            assert code.split(unit) == code.merge(unit), (vocabulary, unit)
            greedy, at = [], 0
            while at < len(unit):
                greedy.append(max((p for p in code.usable if unit.startswith(p, at)), key=len, default=unit[at]))
                at += len(greedy[-1])
            back += greedy != code.split(unit)
    assert back > 300  # splits that the longest match alone gets wrong
    wide = MergePieces({"a": (0, 0.0), "b": (1, 0.0), "ab": (2, -1.0), "ba": (3, -1.0), "aab": (4, -2.0)}, list(range(10, 266)), {})
    unit = "".join(random.Random(1).choice("ab") for _ in range(700))  # beyond the small bitfield
    assert wide.split(unit) == wide.merge(unit)


def test_units_are_never_crossed():
    assert unit_pattern(["a▁b", "x"]).findall("a▁b ▁") == ["a▁b ▁"]
    assert unit_pattern(["▁a", "ab", "."]).findall("▁▁ab.▁.b\nc▁") == ["▁▁ab", ".", "▁", ".", "b", "\n", "c", "▁"]
    assert unit_pattern(["a.", "b"]).findall("ab.▁a") == ["ab.", "▁a"]


def test_piece_edges(spark, pieces, edge_docs, edge_rows, no_docs, monkeypatch):
    _, library = pieces
    want = collections.Counter()
    for i, text, *_ in edge_rows:
        ids = library.encode(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    rows = backtracking.encode(edge_docs, PIECE)
    assert collections.Counter(tuple(r)[:4] for r in rows.collect()) == want
    back = backtracking.decode(rows, PIECE).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((i, library.decode(library.encode(t or ""))) for i, t, *_ in edge_rows)
    assert backtracking.encode(no_docs, PIECE).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert sorted(tuple(r) for r in backtracking.decode(empty, PIECE).collect()) == [(1, None), (2, "")]
    code = MergePieces(pieces[0].pieces, pieces[0].byte_ids, pieces[0].extra)
    monkeypatch.setattr(backtracking, "STORE_UNITS", 3)
    monkeypatch.setattr(backtracking, "STORE_PAIRS", 2)
    for _, text, *_ in edge_rows:
        assert code.encode(text or "") == library.encode(text or "")


# --- 12 ---


def audit_by_hand(rows, labels):
    """{(part, order, step): counts} from (doc_id, text, part) rows and {doc_id: (good, toxic)}."""
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": again}
        docs.append((part or "", {f for f, bad in fails.items() if bad}, *labels.get(i, (0, 0))))
    out, shapley = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_edges(spark, edge_rows, no_docs, monkeypatch):
    rng = random.Random(3)
    rows = [(i, t, s) for i, t, _, s, _ in edge_rows] + [(500 + i, " ".join(rng.choice("AB c d e f# g hh".split()) for _ in range(rng.randrange(150, 260))), rng.choice(["x", None, ""])) for i in range(40)]
    rows += [(900 + i, "copy of one text", "hot") for i in range(60)] + [(900, "copy of one text", "hot"), (None, "copy of one text", "hot"), (None, None, None)]
    marked = [(i, rng.randrange(2), rng.randrange(2)) for i in [*range(0, 30), *range(500, 540), *range(900, 930)]] + [(5, 1, None), (5, None, 1), (None, 1, 1)]
    known = {}
    for i, good, toxic in marked:
        if i is not None:
            known[i] = tuple(max(a, int(b == 1)) for a, b in zip(known.get(i, (0, 0)), (good, toxic)))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, shard int, word int").repartition(3)
    labels = spark.createDataFrame(marked, "doc_id bigint, quality int, toxic int")
    want = audit_by_hand(rows, known)
    for size in (term_matrix.SHARD_BYTES, 300):
        monkeypatch.setattr(term_matrix, "SHARD_BYTES", size)
        got = term_matrix.filter_audit(docs, labels).collect()
        assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want and len(got) == len(want)
    assert term_matrix.filter_audit(no_docs, labels).count() == 0
    assert term_matrix.filter_audit(docs, labels.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


def test_matrix_holds_every_word(spark, edge_docs, edge_rows):
    matrix, dictionary = term_matrix.document_terms(edge_docs)
    word = {r.code: r.word for r in dictionary.collect()}
    assert len(set(word.values())) == len(word) and [word[c] for c in sorted(word)] == sorted(word.values(), key=lambda w: w.encode())
    got = []
    for shard in matrix.collect():
        for n, i in enumerate(shard.ids):
            cells = slice(shard.starts[n], shard.starts[n + 1])
            assert shard.codes[cells] == sorted(set(shard.codes[cells]))
            got.append((i, tuple(sorted((word[c], k) for c, k in zip(shard.codes[cells], shard.counts[cells])))))
    want = [(i, tuple(sorted(collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")).items()))) for i, t, *_ in edge_rows]
    assert collections.Counter(got) == collections.Counter(want)
    words, starts, codes, counts = term_matrix.csr(pa.array(["", "b a  b", " \n"]))
    assert (words.to_pylist(), starts.tolist(), codes.tolist(), counts.tolist()) == (["a", "b"], [0, 0, 2, 2], [0, 1], [1, 2])


# --- 11 ---


def phrases_by_hand(rows, min_count, most, top, num, den):
    """(lang, rank, phrase, a, l, r, n, score) from (text, lang) rows."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= min_count}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and den * c >= num * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p, a, left, right, n[lang], -s) for rank, (s, _, _, p, a, left, right) in enumerate(sorted(found)[:top], 1)]
    return out


def spoken(rng, n):
    return [("".join(rng.choice(["new york city ", "New  York, ", "the ", "of the ", "zé\tù ", "a.b ", "the end of the day ", "x y ", "\n", "one two three four five ", "! "]) for _ in range(rng.randrange(0, 12))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("sample, bits", [(0.2, None), (0.0, None), (1.0, None), (0.5, 64)])
def test_phrases_edges(spark, edge_rows, no_docs, monkeypatch, sample, bits):
    """The sample and the bitmap's size (64 bits: nearly all set) change the work only."""
    if bits:
        monkeypatch.setattr(collocations, "BITS", 1 << 15)
        monkeypatch.setattr(collocations, "holds", lambda bitmap, hashes: np.ones(len(hashes), bool))
    rows = spoken(random.Random(5), 150) + [(t, lang) for _, t, lang, *_ in edge_rows] + [("Same words here. " * 200, "hot")] * 3 + [("one", "few"), (None, "none")]
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, f int").repartition(3)
    for min_count, most, top, num in ((5, 4, 2000, 80), (3, 3, 6, 100)):
        got = collocations.collocations(docs, min_count=min_count, most=most, top=top, num=num, den=100, sample=sample)
        assert sorted(tuple(r) for r in got.collect()) == sorted(phrases_by_hand(rows, min_count, most, top, num, 100))
    assert collocations.collocations(no_docs).count() == 0


def test_failures_of_the_border_are_found(spark):
    """A sample that holds nothing proposes nothing: all phrases are border or beyond, and still found in one expansion."""
    rows = spoken(random.Random(6), 120)
    docs = spark.createDataFrame(rows, "text string, lang string")
    texts = docs.selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    for proposed in (bytes(collocations.BITS // 8), bytes([0x55]) * (collocations.BITS // 8)):
        found, totals = collocations.frequent_phrases(texts, 4, 4, proposed)
        want = {(lang, p): a for lang, _, p, a, *_ in phrases_by_hand(rows, 4, 4, 10**6, 10**9, 1)}
        assert {(r.lang, r.phrase): r.f for r in found.collect() if r.words > 1} == want and totals.count() == 3


def test_scores_don_t_overflow(spark):
    big = 9 * 10**14
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big)], "lang string, words int, phrase string, f bigint")
    rows = collocations.scored(found, spark.createDataFrame([("en", 3 * big)], "lang string, n bigint")).collect()
    assert [(r.a, r.score) for r in rows] == [(big, 1_000_000)]


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_filter_audit"])
def test_query_matches_sql(spark, name):
    same(queries()[name](spark, DATA), connect(), oracle_sql()[name])
