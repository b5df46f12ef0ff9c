"""What was mended because it took too long, or too much memory or disk, on large tables."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkronym.operators import crf
from sparkronym.operators import extract as Ex
from sparkronym.operators import representators as R
from sparkronym.plans import expand as P


def test_models_of_equal_sentences_are_those_of_all(spark):
    """A row that stands for several is learnt from as often as it says, by each model of its own."""
    rows = [(k, k % 3, [[0, 1 + k % 4], [0, 5 + k % 2]], ["B-short", ("O", "B-long")[k % 2]]) for k in range(12)]
    d = spark.createDataFrame(rows, "k int, fold int, features array<array<int>>, tags array<string>")
    want = crf.fit(d.unionAll(d.where("k % 4 = 1")), folds=3, dims=8, steps=20, gain=0.0)
    folded = d.withColumn("many", F.expr("transform(sequence(0, 2), m -> if(fold = m, 0, if(k % 4 = 1, 2, 1)))")).drop("fold")
    got = crf.fit(folded, folds=3, dims=8, steps=20, gain=0.0)
    assert all(np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.move, b.move, atol=1e-6) for a, b in zip(want, got, strict=True)) and got[0].weights.any()


@pytest.mark.parametrize("far", [1.0, 3000.0])
def test_sums_over_sequences_of_far_scores(far):
    r = np.random.default_rng(0)
    emit, move = r.normal(size=(2, 4, 3, 3)) * far, r.normal(size=(2, 3, 3)) * far
    got = crf._side_by_side(emit, move, np.ones((2, 4)))
    for k in range(2):
        for x, y in zip(got, crf._in_logs(emit[k], move[k], np.ones(4)), strict=True):
            assert np.allclose(x[k], y, rtol=1e-9, atol=1e-9)


def test_sentences_of_all_lengths_and_tokens_without_features():
    s = crf.Sentences(pa.array([[[0], [], [1, 1]], [], [[]]], pa.list_(pa.list_(pa.int32()))))
    weights = np.array([[1.0, 2.0], [3.0, 5.0]])
    assert s.scores(weights).tolist() == [[1, 2], [0, 0], [6, 10], [0, 0]]
    loss, grad, _ = crf.loss_and_gradient(s, np.array([0, 0, 1, 0]), weights, np.zeros((2, 2)))
    p = 1 / (1 + np.exp(-1)), 1 / (1 + np.exp(-4))
    assert abs(loss - (-np.log(1 - p[0]) - np.log(0.5) - np.log(p[1]) - np.log(0.5))) < 1e-9
    assert np.allclose(grad, [[-p[0], p[0]], [2 * (1 - p[1]), -2 * (1 - p[1])]])


def test_each_text_is_expanded_once(spark, tmp_path):
    """However many articles have it; two rows of one id are one article."""
    from sparkronym.operators import matchers

    def rule(text):
        with open(tmp_path / "seen", "a") as f:
            f.write(text + "\n")
        return matchers.RULES["schwartz_hearst"](text) | {w: None for w in text.split() if w.isupper()}

    corpus = P.Corpus(
        spark.createDataFrame([("a", "red star_x sky"), ("b", "blue round x_y sea")], "article_id string, raw_text string"),
        spark.createDataFrame([("RS", "red sky", "a", 1), ("RS", "round sea", "b", 2), ("BC", "big cat", "b", 3)], "acronym string, expansion string, article_id string, pos int"),
    )
    rows = [(f"{k}", ("RS red", "RS blue", "BC is here")[k % 3]) for k in range(30)] + [("two", "RS red"), ("two", "RS blue round sea"), (None, "The old dog (OD) BC"), ("none", None)]
    Ex.REGISTRY["counted"] = rule
    got = P.expand(spark.createDataFrame(rows, "article_id string, raw_text string").repartition(5), corpus, P.RunConfig(rule="counted")).collect()
    del Ex.REGISTRY["counted"]
    seen = (tmp_path / "seen").read_text().splitlines()
    assert all(seen.count(x) <= 2 for x in ("RS red", "RS blue", "BC is here"))  # alone, and in the article of two rows
    want = {(str(k), *(("RS", "red sky"), ("RS", "round sea"), ("BC", "big cat"))[k % 3]) for k in range(30)} | {("two", "RS", "round sea"), (None, "OD", "old dog")}
    assert {(r["article_id"], r["acronym"], r["expansion"]) for r in got} == want


def test_tfidf_shuffles_no_row_of_an_article_and_term(spark, monkeypatch):
    """Blocks of a few tokens against counting by hand; two rows of one id are one article."""
    monkeypatch.setattr(R, "BLOCK_TOKENS", 4)
    rows = [("a", "x é x y".split()), ("b", "y z é".split()), ("c", []), ("d", None), ("e", ["", "x", "日本"]), ("a", ["z"]), ("f", ["only"]), ("g", ["stop", "x"])]
    got = R.tfidf(spark.createDataFrame(rows, "article_id string, tokens array<string>").repartition(3), ngram=(1, 2), stop_words=["stop"])
    tf = Counter((k, g) for k, t in rows for g in (t or []) + [f"{a} {b}" for a, b in zip(t or [], (t or [])[1:], strict=False)] if g != "stop")
    df = Counter(g for _, g in tf)
    raw = {(k, g): n * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for (k, g), n in tf.items()}
    norm = {k: math.hypot(*(w for (i, _), w in raw.items() if i == k)) for k, _ in raw}
    found = {(r["article_id"], r["term"]): r["weight"] for r in got.collect()}
    assert found.keys() == raw.keys() and all(abs(found[k] - w / norm[k[0]]) < 1e-12 for k, w in raw.items())
    assert "hashpartitioning(article_id" not in got._jdf.queryExecution().executedPlan().toString()
