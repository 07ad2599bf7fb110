"""Operator 2: byte-level BPE by content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts texts where their content says so, hence texts with a passage in common
have its chunks in common. Digests of all chunks are counted over all documents; the chunks whose sharing saves most
(``SHARED``) are encoded once for the whole table and their ids go to every worker. All other chunks are encoded where they
stand, once by each worker's own store, so nothing hangs on the bound but time.

Ids of a chunk hold but for its ends, where its neighbours change what the pre-tokenizer sees. A join is repaired by encoding a
window again: from the last two pieces of what is before (their start is a piece's start whatever follows) over the first pieces
of the next chunk, more and more of them, until the last piece of the window is the chunk's own. From there on
both agree to the end, as pieces hang on nothing before their start. A chunk that never agrees joins the window.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, small_batches, text_bytes

WINDOW, MASK = 16, np.uint64((1 << 9) - 1)
#: Shared chunks that are encoded once and broadcast, those of most bytes saved (about 1 kB each).
SHARED = 20_000
#: Bytes of other chunk text that a worker keeps encoded; beyond it the store starts anew. Digests that a task counts before it passes them on.
STORE_BYTES, COUNTED = 24 << 20, 100_000
#: Pieces at the start of a chunk that a join may re-encode.
HEAD = 6
# Fixed value: the pre-tokenizer's pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_rng = np.random.default_rng(7)
_GEAR = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_made: dict[str, ChunkCoder] = {}


def cuts(data: np.ndarray) -> np.ndarray:
    """Offsets at which the rolling hash ends a chunk, moved on to the start of a code point."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    gear, n = _GEAR[data], len(data) - WINDOW + 1
    rolled = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + gear[j : j + n]
    at = np.flatnonzero((rolled >> np.uint64(40)) & MASK == MASK) + WINDOW
    at = at[at < len(data)]
    for _ in range(3):
        inside = (data[at] & 0xC0) == 0x80
        at = at + inside
        at = at[at < len(data)]
    return np.unique(at)


def chunks(raw: bytes, at: np.ndarray) -> Iterator[bytes]:
    start = 0
    for end in [*at.tolist(), len(raw)]:
        if end > start:
            yield raw[start:end]
        start = end


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


class ChunkCoder:
    """Encoder and decoder for one tokenizer file; gives exactly the ids of the tokenizers library."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces, self.scan = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.digits = [str(i) for i in range(size)]
        self.shared: dict[bytes, bytes] = {}  # pickled: they are read on use, so a worker holds no second copy of the broadcast
        self.store: dict[bytes, tuple] = {}
        self.held = 0

    def of(self, pieces: list[str]) -> list[int]:
        """Ids of pieces that something follows. White space at their end is encoded apart: there it would be one piece with what is before."""
        apart = bool(pieces) and pieces[-1][-1].isspace()
        return self.plain("".join(pieces[: len(pieces) - apart])) + (self.plain(pieces[-1]) if apart else [])

    def made(self, raw: bytes) -> tuple:
        """() of a chunk of few pieces, else (its first pieces, where each begins in the ids, ids but of the last two pieces, these two as text)."""
        text = raw.decode()
        pieces = [m[0] for m in islice(self.scan(text), HEAD)]
        start, head, at = sum(map(len, pieces)), [], [0]
        # A space after what is none begins a piece, so the end can be read without all that is before it.
        space, tail = text.rfind(" ", start + 1, len(text) - 1), []
        for _ in range(4):
            if space < 0 or len(tail) > 2:
                break
            if not text[space - 1].isspace():
                tail = self.pieces(text[space:])
            space = text.rfind(" ", start + 1, space)
        if len(tail) < 3:
            tail = self.pieces(text[start:])
        if len(pieces) < HEAD or len(tail) < 3:
            return ()
        for piece in pieces:
            head += self.plain(piece)
            at.append(len(head))
        last = tail[-2] + tail[-1]
        inner = text[start : len(text) - len(last)]
        apart = tail[-3] if tail[-3][-1].isspace() else ""
        ids = head + self.plain(inner[: len(inner) - len(apart)]) + (self.plain(apart) if apart else [])
        return pieces, at, array("i", ids), last

    def chunk(self, raw: bytes) -> tuple:
        key = digest(raw)
        if key in self.shared:
            return pickle.loads(self.shared[key])
        found = self.store.get(key)
        if found is None:
            if self.held > STORE_BYTES:
                self.store.clear()
                self.held = 0
            found = self.store[key] = self.made(raw)
            self.held += len(raw)
        return found

    def encode(self, raw: bytes, at: np.ndarray) -> list[int]:
        """Ids of a text that is cut at ``at``."""
        if any(s.encode() in raw for s in self.special):
            return self.full.encode(raw.decode(), add_special_tokens=False).ids
        out: list[int] = []
        open_: list[str] = []  # text whose pieces aren't settled; it begins where a piece does

        def settle() -> None:
            """Ids of the open text's pieces but for the last two."""
            pieces = self.pieces("".join(open_))
            if len(pieces) > 2:
                last = pieces[-2] + pieces[-1]
                out.extend(self.of(pieces[:-2]))
                open_[:] = [last]

        for part in chunks(raw, at):
            found = self.chunk(part)
            if not found:
                text = part.decode()
                open_.append(text)
                if len(self.pieces(text)) > 1:
                    settle()
                continue
            head, starts, ids, last = found
            agreed = 0 if not open_ else None
            before = "".join(open_)
            for n in (2, 4, HEAD) if open_ else ():
                window = self.pieces(before + "".join(head[:n]))
                if len(window) > 1 and window[-1] == head[n - 1]:
                    out += self.of(window[:-1])
                    agreed = n - 1
                    break
            if agreed is None:
                open_.append(part.decode())
                settle()
            else:
                out += ids[starts[agreed] :]
                open_[:] = [last]
        if open_:
            out += self.plain("".join(open_))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode("utf-8")


def coder(path: str) -> ChunkCoder:
    if path not in _made:
        _made[path] = ChunkCoder(path)
    return _made[path]


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in slices(batches):
        data, at = text_bytes(batch.column(1))
        raw = data.tobytes()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield from chunks(raw[a:b], cuts(data[a:b]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, how often, bytes) of the chunks of a task."""
    found: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["digest", "n", "bytes"])

    for part in _chunks_of(batches):
        found.setdefault(digest(part), [0, len(part)])[0] += 1
        if len(found) >= COUNTED:
            yield out()
            found = {}
    if found:
        yield out()


def _texts_of(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted.value)
        for part in _chunks_of(batches):
            key = digest(part)
            if key in left:
                left.remove(key)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([part], pa.binary())], names=["digest", "raw"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            made = [pickle.dumps(code.made(raw)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["digest", "made"])

    return run


def shared_chunks(texts: DataFrame, tokenizer: str) -> dict[bytes, bytes]:
    """{digest: pickled chunk} of the SHARED chunks whose reuse saves most, each encoded once; from (doc_id, text) rows."""
    counts = texts.mapInArrow(_counted, "digest binary, n bigint, bytes bigint").groupBy("digest").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).where("n > 1")
    best = counts.orderBy(F.desc(F.expr("(n - 1) * bytes")), "digest").limit(SHARED).select("digest").collect()
    wanted = texts.sparkSession.sparkContext.broadcast(frozenset(bytes(r.digest) for r in best))
    if not best:
        return {}
    one = texts.mapInArrow(_texts_of(wanted), "digest binary, raw binary").groupBy("digest").agg(F.first("raw").alias("raw"))
    return {bytes(r.digest): bytes(r.made) for r in one.mapInArrow(_encoded(tokenizer), "digest binary, made binary").collect()}  # SHARED rows at most


def _rows(path: str, with_ids: bool, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        code.shared = shared.value
        for batch in slices(batches):
            data, at = text_bytes(batch.column(1))
            raw, out = data.tobytes(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = code.encode(raw[a:b], cuts(data[a:b]))
                text = ",".join(map(code.digits.__getitem__, ids))
                out.append((len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest(), ids if with_ids else None))
            n, a, b, ids = zip(*out, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, the ids themselves.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the text decoded from them. A null or
    empty text has no ids. A very long text is encoded whole, by one task. Null and repeated ids of rows are carried through, an
    empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(texts, tokenizer))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts.mapInArrow(_rows(tokenizer, with_ids, shared), schema)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x or []).decode() for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids (null or none: empty), special tokens included. Null and repeated ids of rows are carried
    through, an empty table gives no rows; other columns are ignored."""
    small_batches(rows.sparkSession)
    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decoded(tokenizer), "doc_id bigint, text string")
