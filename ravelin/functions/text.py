"""English analyzer: punctuation to spaces, letter tokens, lower case, stopwords, optional Porter stems, lengths 2 to 40."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
_STOP = frozenset(STOPWORDS)
MIN_LEN, MAX_LEN = 2, 40


def lowered(text: Column) -> Column:
    """The letters of a text in lower case, with a space for whatever lies between them."""
    return F.lower(F.regexp_replace(text, r"\P{L}+", " "))


def counted(letters: str, stop: bool = True, stem: bool = False) -> dict[str, int]:
    """How often each of the terms comes in a lowered text."""
    fits = lambda w: MIN_LEN <= len(w) <= MAX_LEN
    n = {w: c for w, c in Counter(letters.split(" ")).items() if (w and stem or fits(w)) and not (stop and w in _STOP)}
    if not stem:
        return n
    stems: Counter = Counter()
    for w, c in n.items():
        stems[porter(w)] += c
    return {w: c for w, c in stems.items() if fits(w)}


def terms(text: Column, stop: bool = True, stem: bool = False) -> Column:
    """Array of the terms of a text, in order and with repeats; null for null. Possessives need no step of their own, as
    letter tokens split them off and the length filter drops the rest. One pass of a pattern leaves the letters, which are
    then lowered as a whole, so that a letter whose lower case holds a mark stays one token."""
    t = F.split(lowered(text), " ")
    fits = lambda w: (F.length(w) >= MIN_LEN) & (F.length(w) <= MAX_LEN)
    if not stem:
        return F.filter(t, lambda w: fits(w) & ~w.isin(STOPWORDS) if stop else fits(w))
    return F.filter(stem_all(F.filter(t, lambda w: ~w.isin(*STOPWORDS, "") if stop else w != "")), fits)


@pandas_udf(ArrayType(StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [porter(w) for w in ws])


def _measure(stem: str) -> int:
    forms = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(forms[i] == "v" and forms[i + 1] == "c" for i in range(len(forms) - 1))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _vowel(w, i - 1)


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
          ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=100_000)
def porter(w: str) -> str:
    """Porter's stemmer of 1980; words of one or two letters stay."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
