"""Queries that read whole tables, held against brute force on small ones."""

import math
import random
from collections import Counter

import pytest

from sparkronym import queries as own
from sparkronym.operators import expanders as E
from sparkronym.operators import metrics as M

PARTS = [(1, "red sky", "T1 A", "B1"), (2, "raw salt", "T2 A", "B1"), (3, "rose stem", "T1 C", "B2"), (4, "big cat", "T1 A", "B2"), (5, "blue car", "T2 C", "B1"), (6, "old dog", "T1 A", "B1")]
ITEMS = [(k, 1, k % 6 + 1, "NR"[k % 2], "OF"[k % 3 % 2]) for k in range(1, 91)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame(ITEMS, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{sf}/lineitem.parquet")
    return sf


def short(name):
    return "".join(w[0].upper() for w in name.split())


NAMES = {k: n for k, n, _, _ in PARTS}


@pytest.mark.parametrize("name", ["e3_cosine", "e6_logistic", "e6_logistic_l1", "e7_svm", "e7_svm_balanced", "e8_random_forest"])
def test_every_ambiguous_mention_is_scored(spark, tables, name):
    got = Counter(r["article_id"] for r in own.QUERIES[name](spark, tables).collect())
    assert got == {f"{k}-1": sum(short(n) == short(NAMES[p]) for n in NAMES.values()) for k, _, p, _, _ in ITEMS if p != 6}


def test_cosine_of_all(spark, tables):
    got = {(r["article_id"], r["expansion"]): r["confidence"] for r in own.QUERIES["e3_cosine"](spark, tables).collect()}
    words = {k: set(f"{t} {b}".split()) for k, _, t, b in PARTS}
    for k, n, p, f, s in ITEMS:
        test = words[p] | {f, s}
        for o, name in NAMES.items():
            if p != 6 and short(name) == short(NAMES[p]):
                assert abs(got[f"{k}-{n}", name] - len(test & words[o]) / math.sqrt(len(test) * len(words[o]))) < 1e-7


def test_candidates_of_all(spark, tables):
    got = {(r["acronym"], r["option"]): r["n"] for r in own.QUERIES["j1_candidates"](spark, tables).collect()}
    assert got == Counter((short(NAMES[p]), n) for _, _, p, _, _ in ITEMS for n in NAMES.values() if short(n) == short(NAMES[p]))


def test_every_item_is_expanded(spark, tables):
    assert {r["article_id"] for r in own.QUERIES["m1_expand"](spark, tables).collect()} == {f"{k}-1" for k, *_ in ITEMS}
    assert [r["gold_pairs"] for r in own.QUERIES["m9_end_to_end_benchmark"](spark, tables).collect() if r["module"] is None] == [len(ITEMS)]


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_dense_cosine_of_all_others(spark, tmp_path, block_rows):
    r = random.Random(1)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(30, 3, [1.0, 0.0, 0.0, 0.0]), (31, 0, [0.0] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (math.hypot(*x) * math.hypot(*y) or 1)
    want = {(str(i), str(k)): max([0.0] + [cos(x, y) for j, m, y in rows if m == k and j != i]) for i, _, x in rows for k in range(4)}
    if block_rows == 4096:
        got = own.QUERIES["e4_e5_dense_cosine"](spark, str(tmp_path))
    else:
        got = E.dense_cosine_others(d.selectExpr("cast(vec_id as string) article_id", "'L' acronym", "cast(label as string) expansion", "embedding vector"), block_rows)
    got = {(x["article_id"], x["expansion"]): x["confidence"] for x in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


TEXTS = [(1, "de la casa de", "es"), (2, 'the "house" de', "en"), (3, None, "en"), (4, "das Haus\tde", None)]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
    return sf


@pytest.mark.parametrize("name", ["r2_tfidf_bigrams", "r3_lda", "r4_document_means", "r5_r8_window_vectors"])
def test_documents_of_all_languages(spark, texts, name):
    ids = {r["article_id"] for r in own.QUERIES[name](spark, texts).select("article_id").collect()}
    assert ids - {"3"} == ({"1", "2"} if name[:2] == "r5" else {"1", "2", "4"})


def test_weights_of_all_languages(spark, texts):
    tf = {(str(k), w): n for k, x, _ in TEXTS if x for w, n in Counter(x.split(" ")).items()}
    df = Counter(w for _, w in tf)
    raw = {(k, w): n * (math.log(5 / (1 + df[w])) + 1) for (k, w), n in tf.items()}
    norm = {k: math.hypot(*(x for (i, _), x in raw.items() if i == k)) for k, _ in raw}
    for name, want in (("r1_context_vectors", {k: n / 2 for k, n in tf.items()}), ("r2_tfidf", {k: x / norm[k[0]] for k, x in raw.items()})):
        got = {(r["article_id"], r["term"]): r["weight"] for r in own.QUERIES[name](spark, texts).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_spaces_of_all_documents(spark, texts):
    got = {r["doc_id"]: (r["text"], r["plain"]) for r in own.QUERIES["f22_f24_spaces"](spark, texts).collect()}
    assert got == {k: (x and x.replace("\t", " ").replace('"', "'"), x and x.replace("\t", "")) for k, x, _ in TEXTS}


def test_sizes_of_vectors_are_the_defaults(spark, texts):
    for name, n in (("r3_lda", 100), ("r4_document_means", 200), ("r5_r8_window_vectors", 200)):
        assert {r["n"] for r in own.QUERIES[name](spark, texts).collect()} - {-1} == {n}


def test_rounds_are_the_defaults(spark, tables, tmp_path, monkeypatch):
    l = [(i, i * 7 % 5 % 2, i % 2) for i in range(40)]  # noqa: E741
    spark.createDataFrame(l, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame([(i, a, b, float(a)) for i, a, b in l], "item long, a int, b int, value double")
    assert own.QUERIES["m10_randomisation_test"](spark, str(tmp_path)).collect() == M.randomisation_test(d.select("item", "a", "b"), 1000).collect()
    assert own.QUERIES["m11_t7_bootstrap"](spark, str(tmp_path)).collect() == M.bootstrap(d.select("item", "value"), 10_000).collect()
    assert {r["fold"] for r in own.QUERIES["m8_out_expansion_benchmark"](spark, tables).collect()} == set(range(5))
    shares = {round(r["confidence"] * 100, 6) for r in own.QUERIES["e8_random_forest"](spark, tables).collect()}
    assert all(x == int(x) for x in shares) and any(x % 20 for x in shares)
    monkeypatch.setattr(own, "scored", lambda *_: None)
    monkeypatch.setattr(E, "trained_vote", lambda scores, gold, rounds=100: (None, rounds))
    monkeypatch.setattr(E, "choose", lambda x: x)
    assert own.QUERIES["e14_trained_vote"](spark, tables) == 100


def test_term_cosine_of_all(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(4)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    terms = {k: [sum(x) for x in zip(*(v for _, m, v in rows if m == k), strict=True)] for k in range(3)}
    got = {(x["article_id"], x["expansion"]): x["confidence"] for x in own.QUERIES["e4_term_cosine"](spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for i, _, v in rows:
        for k, w in terms.items():
            assert abs(got[str(i), str(k)] - max(0.0, sum(a * b for a, b in zip(v, w, strict=True)) / (math.hypot(*v) * math.hypot(*w)))) < 1e-7
