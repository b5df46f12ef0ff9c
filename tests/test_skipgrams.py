"""Word vectors of blocks of documents, and sums of words' vectors, against plain ones."""

import numpy as np
from pyspark.sql import functions as F

from sparkronym.operators import paragraphs as P
from sparkronym.operators import representators as R
from sparkronym.operators import skipgrams as S
from tests.test_paragraphs import TOPICS


def corpus(spark):
    r = np.random.default_rng(4)
    rows = [(str(k), r.choice(TOPICS[k % 3], 40).tolist()) for k in range(60)] + [("none", None), ("empty", []), ("null", [None, "sun"])]
    return spark.createDataFrame(rows, "article_id string, tokens array<string>").repartition(3), rows


def test_a_step_follows_the_gradient():
    """two words without noise; each moves by the rate times the other's share of the gradient."""
    x, y = np.array([[0.5, -1.0], [0.25, 0.5]], np.float32), np.array([[1.0, 2.0], [-1.0, 0.5]], np.float32)
    x0, y0 = x.copy(), y.copy()
    S.skip(np.array([0, 1]), np.array([7, 7]), x, y, 1, 1, 0, np.random.default_rng(0))
    step = lambda c, w: S.RATES[0] * (1 - P.sigmoid(x0[c] @ y0[w]))
    assert np.allclose(x, x0 + [step(0, 1) * y0[1], step(1, 0) * y0[0]]) and np.allclose(y, y0 + [step(1, 0) * x0[1], step(0, 1) * x0[0]])
    S.skip(np.array([0, 1]), np.array([7, 8]), x0, y, 1, 1, 0, np.random.default_rng(0))
    assert np.allclose(x0, [[0.5, -1.0], [0.25, 0.5]])  # words of two documents aren't near


def test_blocks_means_by_counts(spark, monkeypatch):
    """Words in several blocks have the mean of what each block learnt; the rounds' words are near within topics."""
    d, rows = corpus(spark)
    for tokens in (10**6, 600):
        monkeypatch.setattr(S, "FIT_TOKENS", tokens)
        each, table = R.word_vectors(d, 16, 4, epochs=60)
        parts, n = {}, {}
        for r in each.collect():
            parts[r["term"]] = parts.get(r["term"], 0) + r["n"] * np.array(r["vector"])
            n[r["term"]] = n.get(r["term"], 0) + r["n"]
        got = {r["term"]: np.array(r["vector"]) for r in table.collect()}
        assert sum(n.values()) == 60 * 40 + 1 and set(got) == {w for t in TOPICS for w in t} and each.select("block").distinct().count() == (1 if tokens == 10**6 else 5)
        assert all(np.allclose(got[w], parts[w] / n[w], atol=1e-5) for w in got)
        v = np.array([got[w] for t in TOPICS for w in t])
        v -= v.mean(0)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        cos, topic = v @ v.T, np.repeat(range(3), 6)
        assert cos[topic[:, None] == topic].mean() > cos[topic[:, None] != topic].mean() + 0.2
        assert sorted(map(tuple, table.select("term", F.col("vector").cast("string")).collect())) == sorted(map(tuple, R.word_vectors(d.repartition(5), 16, 4, epochs=60)[1].select("term", F.col("vector").cast("string")).collect()))


def test_rare_words_are_no_tokens(spark):
    d = spark.createDataFrame([("1", ["a", "b", "a"]), ("2", ["b", "c", None])], "article_id string, tokens array<string>")
    assert {r["term"]: r["n"] for r in R.word_vectors(d, 4, 2, min_count=2)[0].collect()} == {"a": 2, "b": 2}


def test_sums_and_means(spark, monkeypatch):
    """By key, rows of one key together; words without a vector don't count."""
    monkeypatch.setattr(S, "SUM_TOKENS", 300)
    d, rows = corpus(spark)
    d = d.unionByName(d.where("article_id = '3'"))
    own = {w: [float(i), 1.0, -0.5 * i] for i, w in enumerate(w for t in TOPICS for w in t if w != "moon")}
    vectors = spark.createDataFrame(list(own.items()), "term string, vector array<double>")
    want = {k: [own[w] for w in (t or []) if w in own] for k, t in rows}
    got = {r["article_id"]: (r["n"], r["vector"]) for r in S.sums(d, ["article_id"], vectors).collect()}
    assert set(got) == {k for k, v in want.items() if v} and all(n == len(want[k]) * (1 + (k == "3")) and np.allclose(x, np.sum(want[k], 0) * (1 + (k == "3"))) for k, (n, x) in got.items())
    means = {r["article_id"]: r["vector"] for r in R.document_means(d, vectors).collect()}
    assert set(means) == set(got) and all(np.allclose(x, np.mean(want[k], 0)) for k, x in means.items())
    windows = R.window_vectors(spark.createDataFrame([("1", ["a", "de", "b", "c", "de", "d"])], "article_id string, tokens array<string>").withColumn("concept", F.lit("de")), "concept", spark.createDataFrame([("a", [1.0]), ("b", [10.0]), ("d", [100.0])], "term string, vector array<double>"), window=1).collect()
    assert [tuple(r) for r in windows] == [("1", "de", [120.0 + 1])]
