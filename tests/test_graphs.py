"""The graph expander: its gradient, and what it learns in one part or several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkronym.operators import expanders as E
from sparkronym.operators import graphs as G


def test_gradient():
    r = np.random.default_rng(3)
    p = G.start(5, 1)
    p["b1"], p["b2"], p["prior"] = (r.normal(0, 0.1, x.shape) for x in (p["b1"], p["b2"], p["prior"]))
    g = G.Graphs([["a", "b", "a", "c"], [], ["d"], ["b", "b"]], [[0, 1], [2, 4], [1, 2, 3], [0, 4]])
    right = np.array([1, 0, 0, 1, 0, 1, 0, 0, 1.0])
    _, grad = G.loss_and_gradient(p, g, right)
    for name in G.PARTS:
        flat, own = p[name].reshape(-1), grad[name].reshape(-1)
        some = np.unique(np.concatenate((np.flatnonzero(own)[:40], r.integers(0, len(flat), 10) % len(flat))))
        for k in some:
            old, e = flat[k], 1e-5
            flat[k] = old + e
            up = G.loss_and_gradient(p, g, right)[0]
            flat[k] = old - e
            down = G.loss_and_gradient(p, g, right)[0]
            flat[k] = old
            assert abs((up - down) / (2 * e) - own[k]) < 1e-6, (name, k)


def test_edges():
    g = G.Graphs([["a", "b", "a"], ["c"]], [[0], [0]])
    pairs = {(int(a), int(b)) for a, b in zip(g.a, g.b, strict=True)}
    assert pairs == {(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0), (0, 0), (1, 1), (2, 2), (3, 3)}
    x = np.eye(4)
    assert np.allclose(g.mixed(x), g.mixed(x).T)


def test_packing():
    p = G.start(3, 2)
    q = G.unpack(G.pack(p))
    assert all(np.allclose(p[k], q[k], atol=1e-6) and p[k].shape == q[k].shape for k in G.PARTS)


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(9)
    topics = {"red dwarf": "star sky orbit light".split(), "rapid design": "draft plan tool build".split(), "road dust": "car wind stone dry".split()}
    other = ["the", "of", "some", "many", "then"]
    say = lambda e: r.permutation([*r.choice(topics[e], 2), *r.choice(other, 4)]).tolist()
    names = list(topics)
    train = [(f"t{k}", "RD", names[min(k % 5, 2)]) for k in range(150)]  # the last of them most frequent
    tests = [(f"m{k}", "RD", names[k % 3]) for k in range(90)]
    tokens = lambda rows: spark.createDataFrame([(i, say(e)) for i, _, e in rows], "article_id string, tokens array<string>")
    d = spark.createDataFrame([(a, e, i, k) for k, (i, a, e) in enumerate([*train, ("x1", "XY", "x y")])], "acronym string, expansion string, article_id string, pos long")
    return spark.createDataFrame(tests, "article_id string, acronym string, gold string"), d, tokens(tests).cache(), tokens(train).cache()


@pytest.mark.parametrize("part", [1000, 60])
def test_better_than_the_most_frequent(tables, part):
    m, d, tests, train = tables
    right = lambda found: m.join(found, ["article_id", "acronym"]).agg(F.avg((F.col("gold") == F.col("expansion")).cast("double"))).first()[0]
    scores = G.graph_scores(m, d, tests, train, chunks=2, part=part)
    assert right(E.choose(scores)) > 0.9 > 0.5 > right(E.most_frequent(m, d))
    assert all(abs(r["s"] - 1) < 1e-6 for r in scores.groupBy("article_id", "acronym").agg(F.sum("confidence").alias("s")).collect())


def test_mentions_without_words(spark, tables):
    _, d, tests, train = tables
    m = spark.createDataFrame([("nowhere", "RD"), ("nowhere", "XY"), ("m1", "ZZ")], "article_id string, acronym string")
    got = {(r["acronym"], r["expansion"]) for r in G.graph_scores(m, d, tests, train, chunks=2, rounds=1, epochs=1).collect()}
    assert got == {("RD", "red dwarf"), ("RD", "rapid design"), ("RD", "road dust"), ("XY", "x y")}
    assert G.graph_scores(m.where("false"), d, tests, train, chunks=2, rounds=1, epochs=1).count() == 0
