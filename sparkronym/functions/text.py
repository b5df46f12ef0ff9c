"""Scalar functions on texts, as Spark columns. A null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def expansion_token(c: str | Column) -> Column:
    """An expansion as one token: other than word characters become spaces, inner spaces one underscore."""
    spaced = F.trim(F.regexp_replace(col(c), r"[^A-Za-z0-9_]", " "))
    return F.regexp_replace(spaced, r"\s+", "_")


def expansion_token_unicode(c: str | Column) -> Column:
    """As expansion_token, with the letters of all scripts."""
    return F.regexp_replace(F.trim(F.regexp_replace(col(c), r"(?U)\W", " ")), r"\s+", "_")


def singular_acronym(c: str | Column) -> Column:
    """The acronym without one final lower-case s."""
    return F.regexp_replace(col(c), "s$", "")


def tokens(c: str | Column, stop_words: list[str] = ()) -> Column:
    """Lower-cased alphanumeric words that are neither numbers nor stop words.

    Tokens with an underscore are expansion tokens and stay as they are."""
    words = F.filter(F.split(F.regexp_replace(col(c), r"[^A-Za-z0-9_]", " "), r"\s+"), lambda w: w != "")
    words = F.filter(words, lambda w: w.contains("_") | ~w.rlike("^[0-9]+$"))
    words = F.transform(words, lambda w: F.when(w.contains("_"), w).otherwise(F.lower(w)))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def split_spaces(c: str | Column) -> Column:
    """At every single space; empty tokens stay."""
    return F.split(col(c), " ", -1)


def clean_words(c: str | Column) -> Column:
    """Words without punctuation, lower-cased, empty ones dropped."""
    return F.filter(F.split(F.lower(F.regexp_replace(col(c), r"[!-/:-@\[-`{-~]", "")), r"\s+"), lambda w: w != "")


def strip_markup(c: str | Column, tag: str = "e") -> Column:
    return F.regexp_replace(col(c), f"</?{tag}>", "")


#: Accented characters of French and what they fold to; the first eight are all that the reference's map has.
FRENCH_FROM = "éèà’ïÉô\xa0" + "âäêëîöùûüÿçÀÂÄÈÊËÎÏÔÖÙÛÜŸÇ"
FRENCH_TO = "eea'iEo " + "aaeeiouuuycAAAEEEIIOOUUUYC"


def fold_french(c: str | Column) -> Column:
    return F.translate(col(c), FRENCH_FROM, FRENCH_TO)


def no_controls(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[\x00-\x1F\x7F]", "")


def plain_space(c: str | Column) -> Column:
    """Every white-space character as a space, double quotes as single ones."""
    return F.replace(F.regexp_replace(col(c), r"[\x09-\x0D\x20]", " "), F.lit('"'), F.lit("'"))


def detokenise(tokens: str | Column) -> Column:
    """A text from tokens: no space before closing marks and after opening ones."""
    text = F.array_join(col(tokens), " ")
    text = F.regexp_replace(text, r" ([,.!?:;)\]}])", "$1")
    text = F.regexp_replace(text, r"([(\[{]) ", "$1")
    return F.replace(text, F.lit(" 's"), F.lit("'s"))


def literal(s: str) -> str:
    """A pattern for exactly this text, in Java's and RE2's syntax."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


def replace_acronym(text: str | Column, acronym: str | Column, by: str | Column) -> Column:
    """Each stand-alone occurrence of the acronym, or of its plural in s, by a token."""
    quoted = F.concat(F.lit(r"\b\Q"), col(acronym), F.lit(r"\Es?\b"))
    return F.regexp_replace(col(text), quoted, F.regexp_replace(col(by), r"([\\$])", r"\\$1"))


def apply_pairs(text: str | Column, pairs: str | Column) -> Column:
    """The text with each pair's (acronym, expansion) put to the expansion's token, expansions first."""
    step = lambda t, p: replace_acronym(F.replace(t, p["expansion"], expansion_token(p["expansion"])), p["acronym"], expansion_token(p["expansion"]))
    return F.aggregate(col(pairs), col(text), step)


def mask_expansion(text: str | Column, expansion: str | Column, acronym: str | Column) -> Column:
    """Struct: the text with the expansion's token replaced by the acronym, and how often."""
    token = expansion_token(expansion)
    n = ((F.length(col(text)) - F.length(F.replace(col(text), token, F.lit("")))) / F.greatest(F.lit(1), F.length(token))).cast("int")
    return F.struct(F.replace(col(text), token, col(acronym)).alias("text"), n.alias("n"))


def restore_tokens(text: str | Column, expansions: str | Column) -> Column:
    """Expansion tokens of the text as spaced expansions again."""
    return F.aggregate(col(expansions), col(text), lambda t, e: F.replace(t, expansion_token(e), e))


def split_offsets(text: str | Column, part: str | Column) -> Column:
    """The text without a part, with the offsets in it at which the part was."""
    pieces = F.split(col(text), F.concat(F.lit(r"\Q"), col(part), F.lit(r"\E")), -1)
    offsets = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda a, p: a + F.length(p)))
    return F.struct(F.array_join(pieces, "").alias("text"), F.when(F.size(pieces) > 1, offsets).otherwise(F.array().cast("array<int>")).alias("offsets"))


def char_window(text: str | Column, at: Column, before: int, after: int) -> Column:
    """Up to so many characters on both sides of a 1-based place."""
    start = F.greatest(F.lit(1), at - before)
    return F.substring(col(text), start, at + after - start)


_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
#: What counts as a number: digits, with a sign, a dot, single underscores between digits, and an exponent; infinities and nan.
NUMBER = rf"^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))\s*$"


def is_number(c: str | Column) -> Column:
    """Whether the text is a number as a whole; null is none."""
    return F.coalesce(col(c).rlike(NUMBER), F.lit(False))


def stable_hash(seed: int, *cols: str) -> Column:
    """60 bits of the MD5 of seed and columns joined by colons (null as empty): a draw that any engine can repeat."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def url_join(base: str | Column, href: str | Column) -> Column:
    """A link's address: absolute, host-relative, or relative to the page's folder; fragments dropped."""
    h = F.regexp_replace(col(href), "#.*$", "")
    scheme = F.regexp_extract(col(base), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(col(base), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(col(base), r"[?#].*$", "")
    folder = F.when(path == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h == "", path)
        .otherwise(F.concat(folder, h))
    )


def convert_tags(tags: str | Column, scheme: str) -> Column:
    """Tag sequences of other schemes as BIO.

    BIOUL: U is B, L is I. BIOless: a tag without prefix begins a chunk where it differs
    from the one before. BIOUless: the same, and a leading U- is B."""
    t = col(tags)
    if scheme == "BIOUL":
        return F.transform(t, lambda x: F.when(x.startswith("U-"), F.concat(F.lit("B-"), F.substr(x, F.lit(3)))).when(x.startswith("L-"), F.concat(F.lit("I-"), F.substr(x, F.lit(3)))).otherwise(x))
    if scheme not in ("BIOless", "BIOUless"):
        raise ValueError(scheme)

    def one(x, i):
        before = F.when(i > 0, F.try_element_at(t, i)).otherwise(F.lit("O"))
        begins = F.when(x == "O", x).when(x == before, F.concat(F.lit("I-"), x)).otherwise(F.concat(F.lit("B-"), x))
        if scheme == "BIOless":
            return begins
        return F.when(x.startswith("U-"), F.concat(F.lit("B-"), F.substr(x, F.lit(3)))).otherwise(begins)

    return F.transform(t, one)
