"""When two expansions count as the same, and similarities of sets, strings and vectors."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkronym.functions.text import col
from sparkronym.shipping import ship


def plain(c: str | Column) -> Column:
    """Lower-cased, with hyphens as spaces."""
    return F.replace(F.lower(col(c)), F.lit("-"), F.lit(" "))


def prefix4(c: str | Column) -> Column:
    """The first four characters of each word."""
    words = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 4)), " ")


def starts_same_way(a: str | Column, b: str | Column) -> Column:
    """Equal word prefixes of four characters; only the first side is trimmed, lower-cased and freed of hyphens."""
    return prefix4(F.trim(plain(a))) == prefix4(b)


def similar(a: str | Column, b: str | Column) -> Column:
    """The equality of expansions: equal when plain, of equal word prefixes, or at most two edits apart."""
    x, y = plain(a), plain(b)
    return (x == y) | (prefix4(x) == prefix4(y)) | (F.levenshtein(x, y, 2) >= 0)


def distinct_choices(choices: str | Column) -> Column:
    """Whether the first and the last of a list of expansions begin differently."""
    c = col(choices)
    return F.when(F.size(c) < 2, F.lit(False)).otherwise(~starts_same_way(F.element_at(c, 1), plain(F.trim(F.element_at(c, -1)))))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of the sets of lower-cased words; 0 where both are empty."""
    x, y = F.array_distinct(F.split(F.lower(col(a)), " ")), F.array_distinct(F.split(F.lower(col(b)), " "))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def set_jaccard_distance(a: Column, b: Column) -> Column:
    return 1 - F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def masi_distance(a: Column, b: Column) -> Column:
    """One minus Jaccard times 1 (equal), 2/3 (one within the other), 1/3 (overlap) or 0."""
    both = F.size(F.array_intersect(a, b))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    m = F.when((both == small) & (both == large), 1.0).when(both == small, 2 / 3).when(both > 0, 1 / 3).otherwise(0.0)
    return 1 - (1 - set_jaccard_distance(a, b)) * m


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays; 0 where one is all zeros."""
    x, y = col(a), col(b)
    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))


def normalised_confidences(m: str | Column) -> Column:
    """A map's values, raised by the absolute value of a negative minimum, divided by their sum (0 if that is 0)."""
    values = F.map_values(col(m))
    low = F.least(F.array_min(values), F.lit(0.0))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x - low)
    return F.transform_values(col(m), lambda _, v: F.coalesce(F.try_divide(v - low, total), F.lit(0.0)))


def rival_similar(a: str | Column, b: str | Column) -> Column:
    """Equal without case and outer spaces, or a ratio of matching blocks above 0.8."""
    ship()

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = x.lower().strip(), y.lower().strip()
        return x == y or difflib.SequenceMatcher(None, x, y).ratio() > 0.8

    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(*z) for z in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(both, "boolean")(col(a), col(b))
