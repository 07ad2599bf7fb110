"""Operator 13: SentencePiece ids of the merge type, exactly, by backtracking.

The merge procedure joins the adjacent symbols whose joined string has the best score, the leftmost of equals, until
none is left. A split of a text into pieces is its result if and only if every two adjacent pieces are *compatible*: re-merging the
two of them alone never joins anything across their border. So the search never merges a text. Aho-Corasick gives the longest piece
from each character; the search takes it if it is compatible with the piece before it, else the next shorter piece, else it steps
back. The result is unique for every prefix, so a position that failed once fails for good: a bitfield keeps these, and no
position is left twice.

Texts are cut where no piece of the vocabulary crosses (found from the vocabulary), and a bounded store keeps the ids of units
met before. Characters without a piece become pieces of their bytes. Decoding goes back from ids alone.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, small_batches

MARK = "▁"
#: Units of up to STORE_CHARS characters are kept, and pairs of pieces; either store starts anew beyond its size.
STORE_UNITS, STORE_CHARS, STORE_PAIRS = 600_000, 48, 500_000
UNKNOWN = " ⁇ "
_made: dict[str, MergePieces] = {}

codecs.register_error("ledgerloom.each", lambda e: ("�" * (e.end - e.start), e.end))


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Units that no piece crosses: words, signs, each with the marks before it, and characters that stand in no longer piece.

    Signs are the ASCII characters but letters, and whatever stands next to a sign in a piece. Where the vocabulary
    joins words with signs, or a character with a mark after it, texts aren't cut there.
    """
    beside: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in itertools.pairwise(piece):
            beside.setdefault(a, set()).add(b)
            if b == MARK and a != MARK:
                return re.compile("(?s:.+)")
            beside.setdefault(b, set()).add(a)
    first = {chr(i) for i in range(128) if not chr(i).isalpha()}
    alone = {c for c in first if not beside.get(c)}
    signs = first - alone
    while more := {c for s in signs for c in beside.get(s, ())} - signs - {MARK}:
        signs |= more
    if any(c.isalpha() for c in signs):
        signs = set()
    within, single = re.escape("".join(sorted(signs))), re.escape("".join(sorted(alone)))
    return re.compile(f"{MARK}*[^{MARK}{within}{single}]+" + (f"|{MARK}*[{within}]+" if signs else "") + (f"|[{single}]" if alone else "") + f"|{MARK}+")


class MergePieces:
    """Encoder and decoder over {piece: (id, score)} with ids of the 256 bytes.

    ``extra`` holds the text of all other ids: those of control are decoded to nothing.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], extra: dict[int, str]):
        import ahocorasick

        self.pieces, self.byte_ids, self.extra = pieces, byte_ids, extra
        self.pairs: dict[tuple[str, str], bool] = {}
        self.store: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        #: Pieces that merging their own characters gives; no others are ever part of a result.
        self.usable = {p for p in pieces if len(p) == 1 or len(self.merge(p)) == 1}
        for piece in self.usable:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.shorter = {}
        for piece in self.usable:
            if len(piece) > 1:
                self.shorter[piece] = next(piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.usable)
        self.units = unit_pattern(pieces).findall
        top = max([-1, *byte_ids, *extra, *(i for i, _ in pieces.values())]) + 1
        self.bytes_of = [b""] * top
        for piece, (i, _) in pieces.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        for i, text in extra.items():
            self.bytes_of[i] = text.encode()
        self.marked = {i for p, (i, _) in pieces.items() if p.startswith(MARK)}
        self.silent = {i for i, text in extra.items() if not text}
        self.decimal = [str(i) for i in range(top)]

    def merge(self, text: str, border: int = 0) -> list[str]:
        """The pieces of a short text by merging. With a ``border``, [] as soon as a merge crosses it."""
        parts, pieces = list(text), self.pieces
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                known = pieces.get(parts[i] + parts[i + 1])
                if known is not None and (best is None or known[1] > best):
                    best, at = known[1], i
            if best is None:
                break
            if border and sum(map(len, parts[: at + 1])) == border:
                return []
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two stay apart, each whole, when merged together."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= STORE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = len(self.merge(left + right, len(left))) == 2
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit: longest match first, back where no shorter one fits."""
        n = len(unit)
        longest = [1] * n
        for end, length in self.automaton.iter(unit):
            if length > longest[end - length + 1]:
                longest[end - length + 1] = length
        open_, found, at = (1 << (n + 1)) - 1 if n < 512 else bytearray(b"\x01") * (n + 1), [], 0
        wide = n >= 512
        token, known = unit[: longest[0]] if n else None, self.pairs.get
        while token is not None:
            last = found[-1] if found else None
            while True:
                end = at + len(token)
                if (open_[end] if wide else open_ >> end & 1) and (last is None or (known((last, token)) or self.compatible(last, token))):
                    found.append(token)
                    at = end
                    token = unit[at : at + longest[at]] if at < n else None
                    break
                if len(token) > 1:
                    token = self.shorter[token]
                    continue
                if wide:
                    open_[at] = 0
                else:
                    open_ &= ~(1 << at)
                token = found.pop()
                at -= len(token)
                break
        return found

    def unit_ids(self, unit: str) -> list[int]:
        ids = []
        for piece in self.split(unit):
            known = self.pieces.get(piece)
            if known is not None:
                ids.append(known[0])
            else:
                ids += [self.byte_ids[b] for b in piece.encode()]
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        units, store = self.units(MARK + text.replace(" ", MARK)), self.store
        got = list(map(store.get, units))
        if None in got:
            if len(store) > STORE_UNITS:
                store.clear()
                got = [None] * len(units)
            for i, known in enumerate(got):
                if known is None:
                    unit = units[i]
                    got[i] = store.get(unit)
                    if got[i] is None:
                        got[i] = np.array(self.unit_ids(unit), "<i4").tobytes()
                        if len(unit) <= STORE_CHARS and len(store) <= STORE_UNITS:
                            store[unit] = got[i]
        return np.frombuffer(b"".join(got), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the mark put first goes, a byte that isn't part of a character becomes U+FFFD."""
        if not self.silent.isdisjoint(ids):  # bytes on both sides of such an id are no character
            spoken = [list(run) for silent, run in itertools.groupby(ids, self.silent.__contains__) if not silent]
            parts = [b"".join(map(self.bytes_of.__getitem__, run)).decode("utf-8", "ledgerloom.each") for run in spoken]
            return "".join(parts)[1 if spoken and spoken[0][0] in self.marked else 0 :]
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if ids and ids[0] in self.marked else raw).decode("utf-8", "ledgerloom.each")


def merge_pieces(path: str) -> MergePieces:
    """One coder for each worker process and file. Raises where the file asks for what isn't built: other kinds of pieces or normalization."""
    if path not in _made:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  ﬁ Ａ　x "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("a model whose normalization is more than marks for spaces, one put first")
        pieces, byte_ids, extra = {}, [-1] * 256, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_unused(i):
                raise ValueError("a model with unused pieces")
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif model.is_unknown(i) or model.is_control(i):
                extra[i] = UNKNOWN if model.is_unknown(i) else ""
            else:
                pieces[piece] = (i, model.get_score(i))
        if -1 in byte_ids:
            raise ValueError("a model without pieces for all bytes")
        _made[path] = MergePieces(pieces, byte_ids, extra)
    return _made[path]


def _encoded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merge_pieces(path)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                digest = hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest()
                rows.append((len(ids), digest, hashlib.sha256(coder.decode(ids).encode()).hexdigest(), pa.array(ids, pa.int32()) if with_ids else None))
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string())))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                lists = [r[3] for r in rows]
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays(lists)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas), decoded_sha256 (of the text decoded from these ids), and the ids.

    A null or empty text has no ids and decodes to an empty text. Null and repeated ids are carried through, each row for itself; texts of any
    length are read whole, a long run without a cut in one search; an empty table gives an empty result; other columns are
    ignored, whatever their names. Every row stands for itself, so no key can be hot.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_text(docs, id_col, text_col).mapInArrow(_encoded(model, with_ids), schema)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merge_pieces(path)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text. Null ids give a null text, no ids an empty one; ids outside of the vocabulary raise."""
    small_batches(rows.sparkSession)
    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decoded(model), "doc_id bigint, text string")
