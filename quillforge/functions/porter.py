"""Porter's suffix stripping (Program 14(3), 1980, with the author's later rules -bli and -logi).

Suffix tables are tried longest first; a stem's shape is a string of C and V classes, so measure and
the other conditions are questions to that string. Tokens are stemmed once per Arrow batch and form.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

LONGEST = 1_024  # longer tokens become empty
#: Suffixes and what replaces them, where the stem before has a measure of one or more.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go where the stem before has a measure of two or more.
STEP_4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """C for consonants, V for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "C"
        out += "V" if vowel else "C"
    return out


def measure(stem: str) -> int:
    return len(re.findall("V+C", shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "C"


def _short_end(word: str) -> bool:
    return shape(word)[-3:] == "CVC" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replace(word: str, table: dict[str, str], least: int) -> str:
    suffix = _longest(word, table)
    if suffix is None or measure(word[: -len(suffix)]) < least:
        return word
    return word[: -len(suffix)] + table[suffix]


def _inflections(word: str) -> str:
    """Plurals, -ed and -ing, then y after a vowel-bearing stem."""
    word = _strip(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""})
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        suffix = _longest(word, ("ed", "ing"))
        if suffix and "V" in shape(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word):
                word = word if word[-1] in "lsz" else word[:-1]
            elif measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "V" in shape(word[:-1]):
        word = word[:-1] + "i"
    return word


def _strip(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    return word if suffix is None else word[: -len(suffix)] + table[suffix]


def _tail(word: str) -> str:
    suffix = _longest(word, STEP_4)
    if suffix is not None:
        cut = word[: -len(suffix)]
        if suffix in ("sion", "tion"):
            cut += suffix[0]
        if measure(cut) > 1:
            word = cut
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a token; A-Z count as lower case, tokens of two bytes or less stay."""
    word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
    size = len(word.encode())
    if size <= 2:
        return word
    if size > LONGEST:
        return ""
    word = _inflections(word)
    word = _replace(word, STEP_2, 1)
    word = _replace(word, STEP_3, 1)
    return _tail(word)


@pandas_udf(T.ArrayType(T.StringType()))
def _stems(toks: pd.Series) -> pd.Series:
    there = toks.notna()
    rows = toks[there]
    codes, forms = pd.factorize(np.concatenate([np.zeros(0, object), *rows]))
    stemmed = np.array([stem(t) for t in forms], object)[codes] if len(forms) else np.zeros(0, object)
    out = [None] * len(toks)
    ends = np.cumsum([len(t) for t in rows])
    for i, part in zip(np.flatnonzero(there), np.split(stemmed, ends[:-1]) if len(rows) else (), strict=True):
        out[i] = list(part)
    return pd.Series(out, dtype=object)


@pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    forms = {w: stem(w) for w in words.dropna().unique()}
    return pd.Series([forms.get(w) for w in words], dtype=object)


def stem_tokens(lines: DataFrame, toks: str = "toks") -> DataFrame:
    """``lines`` with stemmed ``toks``; a batch stems each of its forms once, and a worker remembers many."""
    return lines.withColumn(toks, _stems(F.col(toks)))


def stems(words: Column) -> Column:
    return stem_word(words)
