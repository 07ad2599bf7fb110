"""Operator 10: token counts by a count-only Viterbi search over a unigram vocabulary.

Aho-Corasick lists the pieces that end at each character; the search carries the best score and the number of
pieces, never the pieces. Ties go as in the tokenizers library's Unigram model: candidates for an end come by
rising start, and only a strictly better score replaces one; a character without a piece of its own may stand alone at ten
below the lowest score, and counts its UTF-8 bytes. The texts are cut before each space (metaspace, one put first),
where no piece crosses, so the count of a text is the sum over its units; a bounded store keeps those met.

The file's pieces and scores are read as a unigram model; nothing is trained.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices, small_batches

MARK = "▁"
STORE_UNITS = 1_000_000
_made: dict[str, CountOnlyViterbi] = {}


class CountOnlyViterbi:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.alone = min(score for _, score in pieces) - 10.0
        self.store: dict[str, int] = {}

    def count(self, unit: str) -> int:
        """Pieces on the best path over a unit."""
        n, single, alone = len(unit), self.single, self.alone
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        end, found = 0, []

        def close(end: int, found: list) -> None:
            top = None
            found.sort(reverse=True)  # longest first, which is by rising start
            for length, score in found:
                s = score + best[end - length]
                if top is None or s > top:
                    top, pieces[end] = s, pieces[end - length] + 1
            char = unit[end - 1]
            if char not in single:
                s = alone + best[end - 1]
                if top is None or s > top:
                    top, pieces[end] = s, pieces[end - 1] + len(char.encode("utf-8", "replace"))
            best[end] = top

        for last, match in self.automaton.iter(unit):
            while end < last:
                end += 1
                close(end, found)
                found = []
            found.append(match)
        while end < n:
            end += 1
            close(end, found)
            found = []
        return pieces[n]

    def total(self, text: str) -> int:
        if not text:
            return 0
        units = text.replace(" ", MARK).split(MARK)
        if not units[0]:
            units = units[1:]
        store = self.store
        got = list(map(store.get, units))
        if None in got:
            if len(store) > STORE_UNITS:
                store.clear()
            for unit in set(units):
                if unit not in store:
                    store[unit] = self.count(MARK + unit)
            got = list(map(store.__getitem__, units))
        return sum(got)


def pieces_of(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every id of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _made:
            _made[path] = CountOnlyViterbi(pieces_of(path))
        search = _made[path]
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([search.total(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens. A null or empty text has none; null and repeated ids are carried through; other columns are ignored."""
    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(_counts(model), "doc_id bigint, n_tokens bigint")
