"""Findings of the fourth round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkronym.functions import text as X
from sparkronym.operators import expanders as E
from sparkronym.operators import paragraphs as Pv
from sparkronym.operators import representators as R
from sparkronym.operators import splits as Sp
from sparkronym.plans import expand as P

PARTS = [(str(k), f"{'red' if k % 3 else 'raw'} {'sky' if k % 2 else 'salt'}", f"T{k % 4} A, B{k % 5}") for k in range(40)]


def parts(spark):
    """Articles, with each text several times, one id twice, and one without a text; and a dictionary."""
    rows = [(i, f"The {e} ({e[0].upper()}{e.split()[1][0].upper()}) of type {x}") for i, e, x in PARTS]
    rows += [(f"{i}-copy", x) for i, x in rows] + [("3", "Another text of the red sky (RS)"), ("none", None)]
    d = [(e[0].upper() + e.split()[1][0].upper(), e, i + c, int(i)) for i, e, _ in PARTS for c in ("", "-copy")]
    return spark.createDataFrame(rows, "article_id string, raw_text string"), spark.createDataFrame(d, "acronym string, expansion string, article_id string, pos long")


def test_texts_are_weighed_once(spark):
    """the weights are those of tfidf(), and a text has one bag however many articles have it."""
    a, _ = parts(spark)
    other = a.where("article_id like '1%'").withColumn("raw_text", F.replace("raw_text", F.lit("type"), F.lit("kind red")))
    words = lambda df: df.select("article_id", X.tokens("raw_text").alias("tokens"))
    for (names, bags), want in zip(R.tfidf_of_texts(a, other), (R.tfidf(words(a)), R.tfidf(words(other), words(a))), strict=True):
        got = names.join(bags, "same").select("article_id", F.explode("bag").alias("x")).select("article_id", "x.term", F.round("x.weight", 9))
        want = sorted(map(tuple, want.select("article_id", "term", F.round("weight", 9)).collect()))
        assert want and sorted(map(tuple, got.collect())) == want
        assert bags.count() == bags.select("same").distinct().count() == names.join(bags, "same").select("same").distinct().count() < names.count()


def test_texts_are_searched_once(spark, monkeypatch):
    """the rule is asked once for a text, and every article has its pairs."""
    a, _ = parts(spark)
    asked = []
    extract = P.extract
    monkeypatch.setattr(P, "extract", lambda df, *how: asked.append(df) or extract(df, *how))
    got = P.build_corpus(a)
    assert asked[0].count() == a.select("raw_text").distinct().count() < a.count()
    want = extract(a).where("expansion is not null").select("article_id", "acronym", "expansion")
    assert sorted(map(tuple, got.dictionary.select("article_id", "acronym", "expansion").collect())) == sorted(map(tuple, want.collect()))
    assert got.articles.count() == 82


def test_folds_by_names_of_texts(spark):
    """folds whose articles name their texts have the accuracies of those whose articles have their own vectors."""
    a, d = parts(spark)
    words = lambda df: df.select("article_id", X.tokens("raw_text").alias("tokens"))

    def plain(m, train, hidden, texts):
        return E.cosine_scores(m, train, R.tfidf(words(hidden), words(texts)), R.tfidf(words(texts)))

    def named(m, train, hidden, texts):
        (articles, bags), (tests, test_bags) = R.tfidf_of_texts(texts, hidden)
        told = train.join(articles, "article_id", "left").select("acronym", "expansion", "same")
        return E.cosine_scores(m.join(tests, "article_id", "left"), told, test_bags, bags)

    articles, folds = P.build_corpus(a).articles, Sp.folds(d).cache()
    one, two = (sorted(map(str, P.out_expansion_benchmark(d, d, folds, f, 5, articles).collect())) for f in (plain, named))
    assert len(one) == 5 and one == two
    test, train = Sp.realign(d, folds, 2, "test"), Sp.realign(d, folds, 2, "train")
    hidden, gold = P.masked(Sp.realign(articles, folds, 2, "test"), test)
    scores = [{tuple(r)[:3]: round(r["confidence"], 9) for r in f(gold.select("article_id", "acronym"), train, hidden, Sp.realign(articles, folds, 2, "train")).collect()} for f in (plain, named)]
    assert scores[0] and scores[0] == scores[1]


@pytest.mark.parametrize("passes", [None, 20])
def test_seeded_words_are_fitted_in_blocks(spark, monkeypatch, passes):
    """no table of pairs of near words; seeds are where blocks start, and words of a topic come near each other."""
    from tests.test_skipgrams import corpus
    from tests.test_paragraphs import TOPICS

    monkeypatch.setattr(Pv, "near_words", None)
    d, _ = corpus(spark)
    seeds = spark.createDataFrame([("sun", [0.1, 0.3] * 8), ("unheard", [0.7] * 16), ("cell", None)], "term string, vector array<double>")
    start = {r["term"]: r["vector"] for r in Pv.seeded_word_vectors(d, seeds, 16, 4, epochs=0, blocks=3).collect()}
    assert np.array_equal(start["sun"], np.float32([0.1, 0.3] * 8)) and len(start) == 19
    got = {r["term"]: np.array(r["vector"]) for r in Pv.seeded_word_vectors(d, seeds, 16, 4, epochs=60, blocks=3, passes=passes).collect()}
    assert set(got) == set(start) and np.array_equal(got["unheard"], np.float32([0.7] * 16)) and not np.allclose(got["sun"], start["sun"])
    v = np.array([got[w] for t in TOPICS for w in t if w != "sun"])
    v -= v.mean(0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos, topic = v @ v.T, np.repeat(range(3), 6)[1:]
    assert cos[topic[:, None] == topic].mean() > cos[topic[:, None] != topic].mean() + 0.2
