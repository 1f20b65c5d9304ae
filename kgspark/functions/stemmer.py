"""The Porter stemmer, from its published rules, as a vectorized function over distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The rules of steps 2, 3 and 4 of the published algorithm, longest suffixes first within a step.
STEP2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _shape(stem: str) -> str:
    """c and v for each letter; y is a vowel behind a consonant."""
    out = ""
    for k, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and k > 0 and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, by in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + by if measure(stem) > 0 else word
    return word


def _inflections(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if measure(stem) == 1 and _closed(stem) else stem
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    word = _inflections(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2), STEP3)
    for suffix in STEP4:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not _closed(rest):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(lambda w: "_".join(map(stem, w.split("_"))))
