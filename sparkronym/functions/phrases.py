"""Finding a phrase in a text that has it nearly: weighted edits, each kind with a limit of its own.

An insertion (a character of the text that the phrase lacks) costs 3, a substitution 2, a
deletion 1. A match starts and ends at a word's edge. For each number of edits of each
kind the places that a prefix of the phrase can reach are one integer, a bit for each
place of the text, so that a step takes all places at once; of all matches within the
limits the cheapest is found, not the first that a greedy search meets.

A text is only searched if it has one of the phrase's pieces as it is: of as many pieces
as edits, and one more, some piece is not edited.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkronym.shipping import ship

#: What an insertion, a deletion and a substitution cost.
INSERTION, DELETION, SUBSTITUTION = 3, 1, 2


class Budget(NamedTuple):
    """Edits of each kind at most (None: half the phrase's length), and the share of the phrase's length that the cost stays below."""

    each: int | None
    share: float

    def limits(self, n: int) -> tuple[int, int]:
        return n // 2 if self.each is None else self.each, int(n * self.share)


#: One budget after the other, until one finds the phrase; the phrase as it is comes first.
TRAIN = (Budget(0, 1.0), Budget(3, 1.0), Budget(None, 1.0))
TEST = (Budget(0, 1.0), Budget(2, 0.5))


class Match(NamedTuple):
    start: int
    end: int
    cost: int
    insertions: int
    deletions: int
    substitutions: int


def edges(text: str) -> tuple[int, int]:
    """The places before which words start, and those before which they have ended, as bits."""
    word = [c.isalnum() or c == "_" for c in text]
    starts = sum(1 << k for k, w in enumerate(word) if w and not (k and word[k - 1]))
    ends = sum(1 << k + 1 for k, w in enumerate(word) if w and not (k + 1 < len(word) and word[k + 1]))
    return starts, ends


def reached(text: str, phrase: str, start: int, each: int, below: int) -> dict[tuple[int, int, int], int]:
    """Places where the phrase can end, as bits, by numbers of insertions, deletions and substitutions, from given starts."""
    where: dict[str, int] = {}
    for k, c in enumerate(text):
        where[c] = where.get(c, 0) | 1 << k
    whole = (1 << len(text) + 1) - 1
    states = {(0, 0, 0): start}

    def inserted(of: dict) -> dict:
        """With insertions before the next character of the phrase."""
        for i, d, s in sorted(of):
            bits, k = of[i, d, s], i
            while bits and k < each and INSERTION * (k + 1) + DELETION * d + SUBSTITUTION * s < below:
                bits, k = bits << 1 & whole, k + 1
                of[k, d, s] = of.get((k, d, s), 0) | bits
        return of

    states = inserted(states)
    for c in phrase:
        new: dict = {}
        for (i, d, s), bits in states.items():
            cost = INSERTION * i + DELETION * d + SUBSTITUTION * s
            for key, to, more in (((i, d, s), (bits & where.get(c, 0)) << 1, 0), ((i, d, s + 1), bits << 1 & whole, SUBSTITUTION), ((i, d + 1, s), bits, DELETION)):
                if to and max(key) <= each and (cost + more < below or not more):
                    new[key] = new.get(key, 0) | to
        states = inserted(new)
    return states


def search(text: str, phrase: str, budget: Budget) -> Match | None:
    """The cheapest match, of equals the one that ends first, then the longest; letters of either case are alike."""
    text, phrase = _lower(text), _lower(phrase)
    each, below = budget.limits(len(phrase))
    if not phrase or below <= 0:
        return None
    starts, ends = edges(text)
    best = None
    for key, bits in reached(text, phrase, starts, each, below).items():
        bits &= ends
        cost = INSERTION * key[0] + DELETION * key[1] + SUBSTITUTION * key[2]
        if bits:
            end = (bits & -bits).bit_length() - 1
            if best is None or (cost, end, key) < best:
                best = (cost, end, key)
    if best is None:
        return None
    cost, end, key = best
    # back from that end, with these very edits
    back = reached(text[:end][::-1], phrase[::-1], 1, max(key), cost + 1)[key]
    begins = [end - k for k in range(back.bit_length()) if back >> k & 1 and starts >> end - k & 1]
    return Match(min(begins), end, cost, *key)


def _lower(text: str) -> str:
    """In lower case, but for letters that would become more than one."""
    return "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


def most_edits(n: Column, budget: Budget) -> Column:
    """How many edits the budget allows a phrase of n characters, the cheap ones first."""
    each = (F.floor(n / 2) if budget.each is None else F.lit(budget.each)).cast("int")
    left = F.greatest(F.lit(0), F.floor(n * budget.share).cast("int") - 1)
    d = F.least(each, left)
    s = F.least(each, F.floor((left - d) / SUBSTITUTION).cast("int"))
    return d + s + F.least(each, F.floor((left - d - SUBSTITUTION * s) / INSERTION).cast("int"))


def may_hold(text: str | Column, phrase: str | Column, budget: Budget) -> Column:
    """Whether the text has a piece of the phrase as it is, which it must for a match within the budget."""
    t, p = F.lower(F.col(text) if isinstance(text, str) else text), F.lower(F.col(phrase) if isinstance(phrase, str) else phrase)
    n = F.length(p)
    size = F.floor(n / (most_edits(n, budget) + 1)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), most_edits(n, budget)), lambda k: F.substring(p, k * size + 1, size))
    ascii_only = ~p.rlike(r"[^\x00-\x7F]") & ~t.rlike(r"[^\x00-\x7F]")  # others may change their length in lower case
    return ~ascii_only | (size < 1) | F.exists(piece, lambda x: t.contains(x))


FOUND = "start int, end int, found string, stage int, cost int, insertions int, deletions int, substitutions int"


def find_phrase(text: str, phrase: str, stages: Sequence[Budget] = TRAIN) -> Column:
    """The phrase in the text by the first stage that finds it: where it starts and ends, what stands there, the stage's
    number, the cost and the edits; null without a match, and for nulls. An empty phrase is nowhere."""
    ship()

    @F.pandas_udf(FOUND)
    def run(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for texts, phrases, first in rows:
            out = []
            for t, p, k in zip(texts, phrases, first, strict=True):
                got = None
                if t is not None and p and k == k and k is not None:
                    for stage in range(int(k), len(stages)):
                        m = search(t, p, stages[stage])
                        if m is not None:
                            got = (m.start, m.end, t[m.start : m.end], stage, *m[2:])
                            break
                out.append(got or (None,) * len(names))
            yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in names if c != "found"})

    t, p = F.col(text), F.col(phrase)
    first = F.coalesce(*(F.when(may_hold(t, p, b), F.lit(k)) for k, b in enumerate(stages)))
    found = run(t, p, first)
    return F.when(found["start"].isNotNull(), found)
