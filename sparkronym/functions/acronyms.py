"""Which strings are acronyms, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkronym.functions.text import col

#: Roman numerals from 1 to 20.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX"]


def _found(text: str | Column, pattern: str) -> Column:
    # word boundaries of all scripts, whatever the Java version
    return F.regexp_extract_all(col(text), F.lit(f"(?U){pattern}"), F.lit(0))


def _upper_half(a: Column) -> Column:
    """More than half of the characters are capitals."""
    return F.length(F.regexp_replace(a, "[^A-Z]", "")) * 2 > F.length(a)


def acronyms_in(text: str | Column, version: str = "v2", words: list[str] = ()) -> Column:
    """The acronyms of a text.

    v1: three to eight capitals, with or without s, but words of a dictionary; v2: three
    to eight capitals; v2_small: two to eight; v3_small: two to eight letters or digits,
    more than half of them capitals; v4: two to eight capitals, repeats kept."""
    if version == "v1":
        found = F.array_distinct(_found(text, r"\b[A-Z]{3,8}s?\b"))
        return F.filter(found, lambda a: ~F.lower(a).isin(list(words))) if words else found
    if version == "v2":
        return F.array_distinct(_found(text, r"\b[A-Z]{3,8}\b"))
    if version == "v2_small":
        return F.array_distinct(_found(text, r"\b[A-Z]{2,8}\b"))
    if version == "v3_small":
        return F.array_distinct(F.filter(_found(text, r"\b[A-Za-z0-9]{2,8}\b"), _upper_half))
    if version == "v4":
        return _found(text, r"\b[A-Z]{2,8}\b")
    raise ValueError(version)


def candidate_tokens(text: str | Column) -> Column:
    """Tokens that may be acronyms: two characters or more, not all small after the first, not an initial with
    its dot, with a letter, and beginning with a letter or digit. Dashes separate tokens."""
    t = F.filter(F.split(col(text), r"[\s\-‐-―]+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.filter(t, lambda w: ~F.substr(w, F.lit(2)).rlike("^[a-z]+$") & ~w.rlike(r"^[A-Z]\.$") & w.rlike("[A-Za-z]") & w.rlike("^[A-Za-z0-9]")))


def upper_tokens(tokens: str | Column) -> Column:
    return F.filter(col(tokens), lambda t: (F.upper(t) == t) & t.rlike("[A-Z]"))


def is_candidate(c: str | Column, function_words: list[str] = (), english: list[str] | None = None) -> Column:
    """Two characters or more, at most two words and ten letters or digits, a letter, no function word; where
    all after the first is small, some word of it must not be English."""
    a = col(c)
    words = F.filter(F.split(a, r"\s+"), lambda w: w != "")
    ok = (F.length(a) >= 2) & (F.size(words) <= 2) & (F.length(F.regexp_replace(a, "[^A-Za-z0-9]", "")) <= 10) & a.rlike("[A-Za-z]")
    if function_words:
        ok = ok & ~F.lower(a).isin(list(function_words))
    if english is not None:
        small = F.substr(a, F.lit(2)).rlike("^[a-z ]+$")
        ok = ok & (~small | F.exists(words, lambda w: ~F.lower(w).isin(list(english))))
    return ok


def has_capital(c: str | Column) -> Column:
    return col(c).rlike("[A-Z]")


def has_letter(c: str | Column) -> Column:
    return col(c).rlike("[A-Za-z]")


def is_short_form(c: str | Column) -> Column:
    """With a letter, and beginning with a letter, digit or opening bracket."""
    return has_letter(c) & col(c).rlike(r"^[A-Za-z0-9(]")


def is_roman(c: str | Column) -> Column:
    return col(c).isin(ROMAN)
