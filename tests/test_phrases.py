"""Approximate search against every substring, and its filter."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from sparkronym.functions import phrases as P


def every_way(a, b):
    """All (insertions, deletions, substitutions) that make phrase b text a."""

    @functools.cache
    def ways(i, j):
        if i == len(a) and j == len(b):
            return frozenset({(0, 0, 0)})
        out = set()
        if i < len(a):
            out |= {(x + 1, y, z) for x, y, z in ways(i + 1, j)}
        if j < len(b):
            out |= {(x, y + 1, z) for x, y, z in ways(i, j + 1)}
        if i < len(a) and j < len(b):
            out |= {(x, y, z + (a[i] != b[j])) for x, y, z in ways(i + 1, j + 1)}
        return frozenset(out)

    return ways(0, 0)


def brute(text, phrase, budget):
    each, below = budget.limits(len(phrase))
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    best = None
    for s in (k for k in range(len(text)) if word(k) and not word(k - 1)):
        for e in (k for k in range(s, len(text) + 1) if word(k - 1) and not word(k)):
            for i, d, x in every_way(text[s:e], phrase):
                cost = 3 * i + d + 2 * x
                if max(i, d, x) <= each and (cost < below):
                    best = min(best or (99, 0, (), 0), (cost, e, (i, d, x), s))
    return best and P.Match(best[3], best[1], best[0], *best[2])


@pytest.mark.parametrize("budget", [*P.TRAIN, P.TEST[1], P.Budget(1, 2.0)])
def test_like_every_substring(budget):
    r = random.Random(8)
    found = 0
    for _ in range(150):
        text = "".join(r.choice("ab b") for _ in range(r.randrange(0, 11)))
        phrase = "".join(r.choice("ab b") for _ in range(r.randrange(1, 6))).strip()
        if phrase:
            want = brute(text, phrase, budget)
            found += want is not None
            assert P.search(text, phrase, budget) == want, (text, phrase)
    assert found


def test_other_numbers_of_words():
    assert P.search("the Redshift surveys", "red shift", P.TRAIN[1]) == P.Match(4, 12, 1, 0, 1, 0)
    assert P.search("a red-shift survey", "red shift", P.TRAIN[1])[:3] == (2, 11, 2)
    assert P.search("the redshifting surveys", "red shift", P.TEST[1]) is None


def rows():
    r = random.Random(2)
    say = lambda n, of: "".join(r.choice(of) for _ in range(n))
    out = [(None, "a"), ("a", None), ("", "a"), ("a", ""), ("data base", "data base"), ("Straße İ data", "strasse"), ("x " * 3000 + "databse system", "data base system")]
    return out + [(say(40, "abc d "), say(8, "abcd ").strip() or "a") for _ in range(60)]


@pytest.mark.parametrize("stages", [P.TRAIN, P.TEST])
def test_column(spark, stages):
    d = spark.createDataFrame([(k, *x) for k, x in enumerate(rows())], "k int, t string, p string").repartition(3)
    got = {r["k"]: r["f"] for r in d.select("k", P.find_phrase("t", "p", stages).alias("f")).collect()}
    for k, (t, p) in enumerate(rows()):
        found = [(s, P.search(t, p, b)) for s, b in enumerate(stages)] if t is not None and p else []
        stage, m = next(((s, m) for s, m in found if m), (None, None))
        f = got[k]
        assert (f is None) == (m is None)
        if m:
            assert (f["start"], f["end"], f["cost"], f["insertions"], f["deletions"], f["substitutions"], f["stage"], f["found"]) == (*m, stage, t[m.start : m.end])


def test_filter_lets_no_match_go(spark):
    d = spark.createDataFrame(rows(), "t string, p string").where("t is not null and p <> ''")
    for b in (*P.TRAIN, P.TEST[1]):
        for r in d.select("t", "p", P.may_hold("t", "p", b).alias("m")).collect():
            assert r["m"] or P.search(r["t"], r["p"], b) is None


def test_filter_leaves_texts_out(spark):
    d = spark.createDataFrame([("nothing like it", "relational database")], "t string, p string")
    assert not d.select(P.may_hold("t", "p", P.TEST[1]).alias("m")).first()["m"]
    assert d.select(F.isnull(P.find_phrase("t", "p")).alias("m")).first()["m"] in (True, False)
