"""Stems of English words by the suffix rules that M. F. Porter published in 1980."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published rules of steps 2 to 4, longest suffix first where one ends in another.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _measure(part: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_vowel(part, i) for i in range(len(part))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(part: str) -> bool:
    return any(_vowel(part, i) for i in range(len(part)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    n = len(word)
    return n > 2 and not _vowel(word, n - 3) and _vowel(word, n - 2) and not _vowel(word, n - 1) and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters, and with other characters than a to z, stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    # 1a, 1b, 1c: plurals, past forms, final y.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    elif (end := _longest(word, ("ed", "ing"))) and _has_vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if (end := _longest(word, rules)) and _measure(word[: -len(end)]):
            word = word[: -len(end)] + rules[end]
    if (end := _longest(word, STEP_4)) and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4] in "st"):
        word = word[: -len(end)]
    # 5a, 5b: final e, double l.
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=["word", "term"])


def stems(words: DataFrame) -> DataFrame:
    """(word, term) of each distinct ``word``: Python sees the vocabulary, not the text."""
    return words.select("word").distinct().mapInArrow(_stems, "word string, term string")
