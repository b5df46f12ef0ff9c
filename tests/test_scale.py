"""Joins and resampling that were reworked for scale, against the plain way."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkronym.functions.similarity import similar
from sparkronym.functions.text import singular_acronym
from sparkronym.operators import expanders as E
from sparkronym.operators import linkage as Ln
from sparkronym.operators import metrics as M


def names():
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    out = ["", "a", "ab", "abc", "Data base", "data-base", "DATA  base", "databse", "dato bases", "database systems", "datum bass", "é", "ée", None]
    out += [word(r.randrange(1, 13)) for _ in range(50)] + [f"{word(4)} {word(3)}" for _ in range(30)] + [f"{word(4)}x {word(4)}y" for _ in range(20)]
    return [(a, e, str(k)) for k, e in enumerate(out) for a in ("AB", "ABs", "Z")[: 1 + k % 3]]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(names(), "acronym string, expansion string, article_id string").repartition(3)


def test_similar_pairs_like_all_pairs(dictionary):
    d = dictionary.select(singular_acronym("acronym").alias("acronym"), "expansion").distinct()
    a, b = d.withColumnRenamed("expansion", "a"), d.withColumnRenamed("expansion", "b")
    want = sorted(map(tuple, a.join(b, "acronym").where((F.col("a") < F.col("b")) & similar("a", "b")).collect()))
    assert sorted(map(tuple, Ln.similar_pairs(dictionary).select("acronym", "a", "b").collect())) == want and len(want) > 50


def test_links_have_the_same_components(dictionary):
    def components(pairs):
        root = {}
        for a, x, y in pairs:
            group = root.get((a, x), {(a, x)}) | root.get((a, y), {(a, y)})
            for v in group:
                root[v] = group
        return {frozenset(g) for g in root.values()}

    both = [components((r["acronym"], r["a"], r["b"]) for r in f(dictionary).collect()) for f in (Ln.similar_pairs, Ln.similar_links)]
    assert both[0] == both[1]


def test_no_acronym_meets_itself_whole(dictionary):
    """In the plan every join on the acronym is on something else as well."""
    plan = Ln.similar_pairs(dictionary)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan and not any("Join Inner, (acronym" in line and " AND " not in line for line in plan.split("\n"))


@pytest.mark.parametrize("seed", range(3))
def test_pieces(spark, seed):
    """Strings of few letters, where many are near: the pairs of all lengths."""
    r = random.Random(seed)
    own = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 8))) for _ in range(120)})
    got = {(x["x"], x["y"]) for x in Ln.near_edits(spark.createDataFrame([("A", s) for s in own], "acronym string, name string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(own, 2) if Ln._edits(a, b) <= 2}


def vectors(spark, ids, seed):
    r = random.Random(seed)
    bags = [[(f"t{r.randrange(9)}", float(r.randrange(1, 4))) for _ in range(r.randrange(1, 5))] for _ in range(12)]
    rows = [(i, t, w) for i in ids for t, w in dict(bags[hash_(i) % 12]).items()]
    return spark.createDataFrame([*rows, ("zero", "t1", 0.0)], "article_id string, term string, weight double"), {i: dict(bags[hash_(i) % 12]) for i in ids}


def hash_(s):
    return sum(map(ord, s)) * 7919


def test_sparse_cosine_like_all_pairs(spark):
    tests, train = [f"m{k}" for k in range(60)], [f"a{k}" for k in range(50)]
    tv, t = vectors(spark, tests, 1)
    av, a = vectors(spark, train, 2)
    m = [(i, "XY"[k % 2]) for k, i in enumerate(tests)] + [("zero", "X"), ("unseen", "X"), (tests[0], "X")]
    d = [("XY"[k % 2], f"e{k % 5}", i) for k, i in enumerate(train)] + [("X", "no article", "gone")]
    got = {tuple(r[:3]): r[3] for r in E.cosine_scores(spark.createDataFrame(m, "article_id string, acronym string"), spark.createDataFrame(d, "acronym string, expansion string, article_id string"), tv, av).collect()}

    def cos(x, y):
        n = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(k, 0) for k, v in x.items()) / n if n else 0.0

    want = {}
    for i, acronym in m:
        for own, e, j in d:
            if own == acronym:
                want[i, acronym, e] = max(want.get((i, acronym, e), 0.0), cos(t.get(i, {}), a.get(j, {})))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_resampling_moments(spark):
    r = np.random.default_rng(0)
    x = np.concatenate((r.integers(0, 2, 400), [0.5, -0.0, 0.0, 7.25]))
    d = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(9999, None)], "item long, value double").repartition(5)
    got = M.bootstrap(d, rounds=4000).first()
    assert abs(got["mean"] - x.mean()) < 0.01
    assert abs((got["high"] - got["low"]) / (2 * 1.645 * x.std() / np.sqrt(len(x))) - 1) < 0.1
    assert M.bootstrap(d.coalesce(1), rounds=4000).first() == got or abs(M.bootstrap(d.coalesce(1), rounds=4000).first()["low"] - got["low"]) < 1e-9


def test_randomisation_like_the_exact_share(spark):
    """Of all ways to swap: few items, so that they can be listed."""
    a, b = [1, 1, 1, 0, 1, 1, 0, 1, 1, 1], [0, 1, 0, 0, 0, 1, 1, 0, 0, 1]
    d = np.array(a) - np.array(b)
    ways = np.abs(np.array(list(itertools.product((1, -1), repeat=len(d)))) @ d) / len(d)
    rows = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(a, b, strict=True))], "item int, a int, b int")
    got = M.randomisation_test(rows, rounds=20_000).first()
    assert abs(got["observed"] - abs(d.mean())) < 1e-12 and abs(got["p_value"] - (ways >= got["observed"] - 1e-12).mean()) < 0.01


def test_resampling_work_is_by_value(spark):
    """A million rows of two values take no longer than two rows."""
    d = spark.range(1_000_000).select(F.col("id").alias("item"), (F.col("id") % 2).cast("double").alias("value"))
    got = M.bootstrap(d, rounds=1000).first()
    assert abs(got["mean"] - 0.5) < 1e-3 and 0 < got["high"] - got["low"] < 0.004


def test_resampling_nothing(spark):
    none = spark.createDataFrame([], "item long, value double, a double, b double")
    assert M.bootstrap(none, rounds=5).first()["mean"] is None and M.randomisation_test(none, rounds=5).first()["observed"] is None
