"""The conditional random field against sums over all tag sequences, and its training."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkronym.operators import crf, matchers


def batch(seed=0, dims=12, tags=3):
    r = np.random.default_rng(seed)
    rows = [[r.integers(0, dims, r.integers(1, 4)).tolist() for _ in range(n)] for n in (1, 3, 2, 3, 4, 1)]
    s = crf.Sentences(pa.array(rows, pa.list_(pa.list_(pa.int32()))))
    gold = [r.integers(0, tags, len(x)).tolist() for x in rows]
    return rows, s, gold, r.normal(size=(dims, tags)), r.normal(size=(tags, tags))


def score(row, tags, weights, move):
    return sum(weights[f, k].sum() for f, k in zip(row, tags, strict=True)) + sum(move[a, b] for a, b in zip(tags, tags[1:], strict=False))


def test_loss_like_the_sum_over_all_sequences():
    rows, s, gold, weights, move = batch()
    want = 0.0
    for row, y in zip(rows, gold, strict=True):
        every = [score(row, t, weights, move) for t in itertools.product(range(3), repeat=len(row))]
        want += np.log(np.exp(every).sum()) - score(row, y, weights, move)
    assert abs(crf.loss_and_gradient(s, np.concatenate(gold), weights, move)[0] - want) < 1e-9


def test_best_sequence():
    for seed in range(5):
        rows, s, _, weights, move = batch(seed)
        want = [max(itertools.product(range(3), repeat=len(row)), key=lambda t, row=row: score(row, t, weights, move)) for row in rows]
        assert crf.Crf(weights, move, ("a", "b", "c")).tag(s).tolist() == [k for t in want for k in t]


def test_gradient():
    _, s, gold, weights, move = batch()
    y = np.concatenate(gold)
    _, by_feature, moves = crf.loss_and_gradient(s, y, weights, move)
    for array, grad in ((weights, by_feature), (move, moves)):
        for at in np.ndindex(array.shape):
            old, e = array[at], 1e-5
            array[at] = old + e
            up = crf.loss_and_gradient(s, y, weights, move)[0]
            array[at] = old - e
            down = crf.loss_and_gradient(s, y, weights, move)[0]
            array[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 1e-5


@pytest.mark.parametrize("l1", [0.0, 0.5])
def test_minimum(l1):
    """Of a quadratic; with an L1 term the optimum is the soft threshold where the axes are independent."""
    scale, goal = np.array([1.0, 4.0, 9.0, 2.0]), np.array([3.0, -1.0, 0.01, -0.2])
    search = crf.minimise(np.zeros(4), l1, tolerance=1e-9)
    x = next(search)
    try:
        while True:
            x = search.send(((scale * (x - goal) ** 2).sum() / 2, scale * (x - goal)))
    except StopIteration as end:
        assert np.allclose(end.value, np.sign(goal) * np.maximum(0, np.abs(goal) - l1 / scale), atol=1e-4)


def sentences():
    """Long and short forms in several orders, with the tags."""
    names = ["red dwarf star", "data base system", "open source tool", "green leaf index", "solar wind probe", "deep sea cable"]
    out = []
    for k in range(120):
        long, a = names[k % 6].split(), "".join(w[0].upper() for w in names[k % 6].split())
        lt, st = ["B-long", *["I-long"] * (len(long) - 1)], ["B-short"]
        shape = [
            (["The", *long, "(", a, ")", "was", "seen"], ["O", *lt, "O", *st, "O", "O", "O"]), ([a, "(", *long, ")", "is", "old"], [*st, "O", *lt, "O", "O", "O"]),
            (["An", a, "stands", "for", *long, "."], ["O", *st, "O", "O", *lt, "O"]), (["Nothing", "of", "the", "kind"], ["O"] * 4),
        ][k % 4]
        out.append((str(k), k % 5, *shape))
    return [*out, ("none", 0, None, None), ("empty", 1, [], []), ("unequal", 2, ["a"], [])]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(sentences(), "article_id string, fold int, tokens array<string>, tags array<string>").repartition(3)
    rule = crf.tags_by_rule(spark, matchers.RULES["schwartz_hearst"])
    df = df.withColumn("said", rule("tokens"))
    return df.withColumn("features", crf.hashed(crf.token_features("tokens", ["said"]), 512)).cache()


def test_features(spark):
    d = spark.createDataFrame([(["The", "ABC", "42"], ["O", "B-short", "O"])], "tokens array<string>, m array<string>")
    got = d.select(crf.token_features("tokens", ["m"]).alias("f")).first()["f"]
    assert set(got[0]) == {"bias", "word=The", "end=The", "title", "m=O", "nothing before", "after=ABC", "after upper"}
    assert set(got[1]) == {"bias", "word=ABC", "end=ABC", "upper", "m=B-short", "before=The", "before title", "after=42"}
    assert {"digits", "nothing after", "before upper"} <= set(got[2])


def test_fit_like_one_machine(spark, rows):
    """The sum over tasks is the sum over rows: the same optimum as a fit of all rows in one batch."""
    model = crf.fit(rows, dims=512, steps=15, gain=0.0)[0]
    data = rows.where("size(features) > 0 and size(features) = size(tags)").select("features", "tags").toArrow()
    s, number = crf.Sentences(data.column("features")), {t: k for k, t in enumerate(crf.TAGS)}
    gold = np.array([number[t] for t in data.column("tags").combine_chunks().flatten().to_pylist()])
    search, x = crf.minimise(np.zeros(512 * 5 + 25), crf.C1, 15, gain=0.0), np.zeros(512 * 5 + 25)
    next(search)
    try:
        while True:
            loss, a, b = crf.loss_and_gradient(s, gold, x[:-25].reshape(512, 5), x[-25:].reshape(5, 5))
            x = search.send((loss + crf.C2 * (x @ x), np.concatenate([a.ravel(), b.ravel()]) + 2 * crf.C2 * x))
    except StopIteration as end:
        x = end.value
    assert np.allclose(model.weights.ravel(), x[:-25], atol=1e-6) and np.allclose(model.move.ravel(), x[-25:], atol=1e-6)


def test_ensemble_tags_sentences_it_has_not_seen(rows):
    models = crf.fit(rows.where("fold > 0").withColumn("fold", F.col("fold") - 1), folds=4, dims=512, steps=25)
    held = crf.tagged(rows.where("fold = 0"), models)
    f1 = {r["tag"]: r["f1"] for r in crf.scores(held).collect()}
    assert len(models) == 4 and min(f1[t] for t in crf.TAGS[1:] if t != "I-short") > 0.9
    assert [r["predicted"] for r in held.where("tokens is null").collect()] == [None]


def test_no_rows(spark, rows):
    model = crf.fit(rows.where("false"), dims=16)[0]
    assert not model.weights.any() and crf.tagged(rows.where("false"), [model]).count() == 0


def test_scores_by_hand(spark):
    d = spark.createDataFrame([(["B-short", "O", "B-long"], ["B-short", "B-long", "O"])], "tags array<string>, predicted array<string>")
    got = {r["tag"]: (r["gold"], r["found"], r["right"], r["f1"]) for r in crf.scores(d).collect()}
    assert got == {"B-short": (1, 1, 1, 1.0), "B-long": (1, 1, 0, 0.0)}
