"""Ids of whole texts by the word-level BPE file, through a bounded cache of encoded words.

The tokenizer never joins anything across ASCII white space, so the ids of a text are those of its words
in order. Plain words (Latin letters, then ASCII punctuation but no apostrophe) are encoded by the same merges held as
byte ranks: the end-of-word mark is written as the byte 0xFF, which UTF-8 never has. All other words go
through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

END = b"\xff"
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")
#: Words kept at once; the cache starts anew beyond it.
CACHE_WORDS = 200_000
_made: dict[str, WordIds] = {}


class WordIds:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte_of[c] for c in (token[:-4] if ends else token)) + END * ends] = i
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[bytes, bytes] = {}

    def fill(self, words: list[bytes]) -> None:
        hard = []
        for w in words:
            text = w.decode("utf-8")
            if m := _PLAIN.fullmatch(text):
                ids = []
                for piece in m.groups():
                    if piece:
                        ids += self.merge(piece.lower().encode("utf-8") + END)
                self.cache[w] = np.array(ids, "<u4").tobytes()
            else:
                hard.append((w, text))
        if hard:
            for (w, _), e in zip(hard, self.full.encode_batch_fast([t for _, t in hard], add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text in UTF-8."""
        words = text.split()
        got = list(map(self.cache.get, words))
        if None in got:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            self.fill(list({w for w, g in zip(words, got, strict=True) if g is None} if self.cache else set(words)))
            got = list(map(self.cache.__getitem__, words))
        return b"".join(got)


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process and file."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
