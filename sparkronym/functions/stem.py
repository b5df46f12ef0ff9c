"""English stems by the published Porter algorithm, and contexts of a term within a budget of tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkronym.shipping import ship

VOWELS = "aeiou"
#: Suffixes of steps 2 to 4 of the published algorithm and what replaces them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in VOWELS or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = max((x for x in table if w.endswith(x)), key=len, default=None)
        if s and _measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = max((x for x in STEP4 if w.endswith(x)), key=len, default=None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stems(s: pd.Series) -> pd.Series:
    memory: dict[str, str] = {}

    def one(x: str) -> str:
        if x not in memory:
            memory[x] = x if "_" in x else stem(x)
        return memory[x]

    return s.map(lambda ws: None if ws is None else [one(x) for x in ws])


def stemmed(tokens: Column) -> Column:
    """Stems of lower-cased words; expansion tokens stay."""
    ship()
    return F.pandas_udf(_stems, "array<string>")(tokens)


def _chunks(texts: pd.Series, terms: pd.Series, budgets: pd.Series) -> pd.Series:
    def one(text, term, budget):
        if text is None:
            return None
        words = text.split()
        places = [i for i, x in enumerate(words) if x == term]
        if not places:
            return " ".join(words[:budget])
        taken, reach = set(places[:budget]), 1
        # one word on each side of each occurrence in turn, until the budget is used
        while len(taken) < min(budget, len(words)) and reach < len(words):
            for p in places:
                for q in (p - reach, p + reach):
                    if 0 <= q < len(words) and len(taken) < budget:
                        taken.add(q)
            reach += 1
        return " ".join(words[i] for i in sorted(taken))

    return pd.Series([one(*x) for x in zip(texts, terms, budgets, strict=True)], dtype=object)


def context_chunks(text: str | Column, term: Column, budget: Column) -> Column:
    """Words about a term's occurrences, taken in turn on both sides, budget at most; without the term the first ones."""
    ship()
    return F.pandas_udf(_chunks, "string")(F.col(text) if isinstance(text, str) else text, term, budget)
