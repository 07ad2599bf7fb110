import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerloom.llm.chunked_bpe import ChunkCoder, chunks, cuts, decode, digest, encode, shared_chunks
from ledgerloom.llm.packing import fullest, pack, plan_bins
from ledgerloom.llm.unigram_counts import CountOnlyViterbi, pieces_of, token_counts
from ledgerloom.llm.word_ids import WordIds

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXT = st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*" \n\t'abcABC.,1é漢▁", "<|endoftext|>", " the", "  ", "'ll", "ing "])), max_size=60).map("".join)


@pytest.fixture(scope="module")
def byte_coder():
    return ChunkCoder(BYTE), Tokenizer.from_file(BYTE)


def chunked(code, text):
    raw = text.encode()
    return code.encode(raw, cuts(np.frombuffer(raw, np.uint8)))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6).map(lambda parts: " ".join(parts) * 3))
def test_chunked_ids_are_the_library_s(byte_coder, text):
    code, library = byte_coder
    want = library.encode(text, add_special_tokens=False).ids
    assert chunked(code, text) == want
    raw = text.encode()
    every = np.array([i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80], np.int64)  # a cut at every code point
    assert code.encode(raw, every) == want
    assert code.decode(want).decode() == library.decode(want, skip_special_tokens=False)
    rng = random.Random(len(raw))
    for step in (9, 30, 80):  # cuts that leave chunks of many pieces, and of few
        assert code.encode(raw, every[[rng.random() < 1 / step for _ in every]] if len(every) else every) == want


def test_joins_of_texts_without_ascii_or_spaces(byte_coder):
    code, library = byte_coder
    rng = random.Random(3)
    words = ["при", "вет", "мир", "слово", "'s", "'", "д,", "漢字", "かな。", "٣٤", "—", "\u3000", "  ", "\n\n "]
    for join in ("", " ", "\u00a0"):
        text = join.join(rng.choice(words) for _ in range(12_000))
        assert chunked(code, text) == library.encode(text, add_special_tokens=False).ids
        used = sum(len(code.chunk(part)) > 1 for part in chunks(text.encode(), cuts(np.frombuffer(text.encode(), np.uint8))))
        assert used > 20
    text = "ab" * 20_000
    assert chunked(code, text) == library.encode(text, add_special_tokens=False).ids


def test_chunks_that_documents_share_are_encoded_once(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(3000))
    texts = [" ".join(word() for _ in range(200)) + " " + passage + " " + " ".join(word() for _ in range(200)) for _ in range(6)] + ["alone " * 3, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    shared = shared_chunks(docs, BYTE)
    count = collections.Counter(digest(c) for t in texts for c in chunks(t.encode(), cuts(np.frombuffer(t.encode(), np.uint8))))
    assert set(shared) == {k for k, n in count.items() if n > 1} and len(shared) > 10
    whole = sorted(tuple(r) for r in encode(docs, BYTE).collect())
    monkeypatch.setattr("ledgerloom.llm.chunked_bpe.SHARED", 3)
    assert len(shared_chunks(docs, BYTE)) == 3 and sorted(tuple(r) for r in encode(docs, BYTE).collect()) == whole
    assert [tuple(r["ids"]) for r in sorted(encode(docs, BYTE).collect())] == [tuple(Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids) for t in texts]


def test_encode_edges_and_decode(edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(BYTE)
    rows = encode(edge_docs, BYTE)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect())
    want = collections.Counter()
    for i, text, *_ in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert {(r.doc_id, r.text) for r in decode(rows, BYTE).collect()} == {(i, t or "") for i, t, *_ in edge_rows}
    assert encode(no_docs, BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_are_the_library_s(text):
    if not hasattr(test_word_ids_are_the_library_s, "made"):
        test_word_ids_are_the_library_s.made = WordIds(WORD), Tokenizer.from_file(WORD)
    code, library = test_word_ids_are_the_library_s.made
    assert np.frombuffer(code.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    library, pieces, seats = Tokenizer.from_file(WORD), collections.Counter(), collections.defaultdict(list)
    total = 0
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            pieces[i, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    for r in rows:
        seats[r.sequence_id].append((r["offset"], r.length))
    for held in seats.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seats), -(-total // capacity)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_edges(edge_docs, edge_rows, no_docs, capacity):
    used, least = check_packing(pack(edge_docs, WORD, capacity=capacity).collect(), [r[:2] for r in edge_rows], capacity)
    assert used <= least * 1.03 + 1
    assert pack(no_docs, WORD).count() == 0


def test_many_equal_lengths_are_salted(spark):
    texts = [(i, "the same words in each") for i in range(3000)] + [(9000 + i, "word " * (i % 700)) for i in range(300)]
    used, least = check_packing(pack(spark.createDataFrame(texts, "doc_id bigint, text string"), WORD).collect(), texts, 4096)
    assert used == least


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12), st.integers(1, 60))
def test_fullest_is_the_best_subset_sum(counts, capacity):
    reach = {0}
    for length, n in counts.items():
        reach = {s + length * k for s in reach for k in range(n + 1) if s + length * k <= capacity}
    found = fullest(sorted(counts, reverse=True), counts, capacity)
    assert sum(k * n for k, n in found) == max(reach) and all(n <= counts[k] for k, n in found)
    plan = plan_bins({k: v for k, v in counts.items() if k <= capacity}, capacity)
    used = collections.Counter()
    for bins, uses in plan:
        assert sum(k * n for k, n in uses) <= capacity
        for k, n in uses:
            used[k] += bins * n
    assert used == {k: v for k, v in counts.items() if k <= capacity}


@pytest.fixture(scope="module")
def unigram():
    library = Tokenizer(models.Unigram(pieces_of(PIECE), 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    return CountOnlyViterbi(pieces_of(PIECE)), library


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_are_the_library_s(unigram, text):
    search, library = unigram
    assert search.total(text) == len(library.encode(text).ids)


def test_count_edges(edge_docs, edge_rows, no_docs, unigram):
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts(edge_docs, PIECE).collect())
    assert got == collections.Counter((i, len(unigram[1].encode(t or "").ids)) for i, t, *_ in edge_rows)
    assert token_counts(no_docs, PIECE).agg(F.count("*")).first()[0] == 0
