"""What the third round's findings were about: whole jobs, and joins that make no more rows than they must."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkronym.functions import text as X
from sparkronym.operators import dictionary as D
from sparkronym.operators import expanders as E


def test_all_french_letters_fold(spark):
    """F23"""
    letters = "àâäéèêëîïôöùûüÿçÀÂÄÉÈÊËÎÏÔÖÙÛÜŸÇ"
    got = spark.createDataFrame([(f"{letters}’\xa0x ñ",)], "t string").select(X.fold_french("t")).first()[0]
    assert got == "aaaeeeeiioouuuycAAAEEEEIIOOUUUYC' x ñ" and len(X.FRENCH_FROM) == len(set(X.FRENCH_FROM)) == len(X.FRENCH_TO)


def test_candidate_counts(spark):
    """as many as the joined rows, which are not made."""
    m = spark.createDataFrame([("A",), ("A",), ("B",), ("C",), (None,)] * 3, "acronym string")
    d = spark.createDataFrame([("A", "x", "1", 1), ("A", "x", "2", 2), ("A", "y", "3", 3), ("B", "x", "4", 4), ("D", "z", "5", 5), (None, "n", "6", 6), ("B", None, "7", 7)], "acronym string, expansion string, article_id string, pos long")
    want = sorted(map(str, D.candidates(m, d).groupBy("acronym", "option").agg(F.count("*").alias("n")).collect()))
    got = D.candidate_counts(m, d)
    assert sorted(map(str, got.collect())) == want and len(want) == 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is aggregated above the join


def bags_of(df):
    return df.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("bag")).withColumn("same", F.concat_ws("|", "bag.term"))


@pytest.mark.parametrize("fn", [E.cosine_scores, E.logistic, E.svm, lambda *a: E.svm(*a, balanced=True, penalty="l1"), E.random_forest])
def test_equal_vectors_are_one(spark, monkeypatch, fn):
    """F5, F13 to F17: no group holds a row for each article or mention, and mentions that name their vectors get the same scores."""
    import pandas as pd

    sizes = lambda left, right: len(left) <= 6 and len(right) <= 4
    schema = "article_id string, term string, weight double"
    av = [(f"a{k}", t, 1.0) for k in range(40) for t in (f"t{k % 4}", "all")]
    tv = [(f"m{k}", t, 1.0) for k in range(60) for t in (f"t{k % 6}", "all")]
    d = [("X", f"e{k % 2}", f"a{k}") for k in range(40)] + [("X", "e2", "gone")]
    m = [(f"m{k}", "X") for k in range(60)] * 2
    d = spark.createDataFrame(d, "acronym string, expansion string, article_id string")
    m, av, tv = spark.createDataFrame(m, "article_id string, acronym string"), spark.createDataFrame(av, schema), spark.createDataFrame(tv, schema)
    own = type(d.groupBy("acronym").cogroup(d.groupBy("acronym")))
    plain = own.applyInPandas

    def checked(self, f, out):
        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            assert sizes(left, right), (len(left), len(right))
            return f(key, left, right)

        return plain(self, run, out)

    monkeypatch.setattr(own, "applyInPandas", checked)
    rows = lambda df: sorted((r["article_id"], r["acronym"], r["expansion"], round(r["confidence"], 9)) for r in df.collect())
    got = rows(fn(m, d, tv, av))
    assert len(got) in (120, 180) and got == rows(fn(m.distinct().join(bags_of(tv), "article_id").drop("bag"), d, bags_of(tv).groupBy("same").agg(F.first("bag").alias("bag")), av))
    best = {}
    for a, _, e, c in got:
        best[a] = max(best.get(a, (-1, "")), (c, e))
    assert all(best[f"m{k}"][1] == f"e{k % 2}" for k in range(60) if k % 6 < 4)


def test_weights_are_rows():
    """A row of weight n counts as n rows."""
    r = np.random.default_rng(0)
    x, y, n = r.integers(0, 2, (12, 5)).astype(float), r.integers(0, 3, 12), r.integers(1, 6, 12)
    many = np.repeat(np.arange(12), n)
    for loss in ("logistic", "hinge2"):
        for penalty, balanced in (("l1", True), ("l2", False)):
            fit = E.linear(loss, 1.0, penalty, balanced)
            assert np.allclose(fit(x, y, n.astype(float), list("abc"))(x), fit(x[many], y[many], np.ones(len(many)), list("abc"))(x))


def test_few_copies_of_vectors(spark, monkeypatch):
    """a block goes to a task for each tile, not for each pair of blocks, and as floats where these are exact."""
    from sparkronym.llm import embeddings

    x = np.random.default_rng(3).normal(size=(3000, 8)).astype(np.float32)
    x[::7] = x[0] + np.float32(1e-3) * x[::7]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 64)
    sent, plain = [0], embeddings.Scratch.save

    def save(self, df, name, *a):
        out = plain(self, df, name, *a)
        if name.startswith("found"):
            plan = df._jdf.queryExecution().analyzed().toString()
            assert "FlatMapCoGroupsInPandas" in plan
            sent[0] += 1
        return out

    monkeypatch.setattr(embeddings.Scratch, "save", save)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(d).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert [got[k] for k in range(3000)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist() and sent == [1]
    assert len(embeddings._short(x[0].astype(float))) == 32 and len(embeddings._short(np.array([0.1, 2.0]))) == 16 and len(embeddings._short(np.array([1e300]))) == 8


@pytest.mark.parametrize("fn", [E.logistic, lambda *a: E.logistic(*a, penalty="l1", c=1.0), lambda *a: E.svm(*a, balanced=True, penalty="l1")])
def test_no_task_holds_all_test_vectors(spark, monkeypatch, fn):
    """F14 to F16: an acronym's different test vectors are answered in parts, by one model, with the same scores."""
    import pandas as pd

    schema = "article_id string, term string, weight double"
    av = [(f"a{k}", t, 1.0) for k in range(24) for t in (f"t{k % 4}", f"u{k % 3}")]
    tv = [(f"m{k}", f"t{j}", float(k % 7 + j)) for k in range(120) for j in range(k % 5)] + [(f"m{k}", "u1", k / 9) for k in range(120)]
    d = spark.createDataFrame([("X", f"e{k % 2}", f"a{k}") for k in range(24)], "acronym string, expansion string, article_id string")
    m, av, tv = spark.createDataFrame([(f"m{k}", "X") for k in range(120)], "article_id string, acronym string"), spark.createDataFrame(av, schema), spark.createDataFrame(tv, schema)
    own = type(d.groupBy("acronym").cogroup(d.groupBy("acronym")))
    plain = own.applyInPandas
    rows = lambda: sorted((r["article_id"], r["expansion"], round(r["confidence"], 9)) for r in fn(m, d, tv, av).collect())
    whole = rows()

    def checked(self, f, out):
        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            assert len(left) <= 40, len(left)
            return f(key, left, right)

        return plain(self, run, out)

    monkeypatch.setattr(own, "applyInPandas", checked)
    monkeypatch.setattr(E, "PART", 12)
    assert rows() == whole and len(whole) == 240


@pytest.mark.parametrize("which", ["options", "nearest"])
def test_vectors_are_sent_by_tiles(spark, monkeypatch, which):
    """a row goes to a task for each tile of a side, not for each block, and the results are those of all pairs."""
    x = np.random.default_rng(5).normal(size=(90, 6)).astype(np.float32)
    x[40:50] = x[7]
    d = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "id long, vector array<double>, label int")
    own = type(d.groupBy("id").cogroup(d.groupBy("id")))
    plain, sent = own.applyInPandas, []
    monkeypatch.setattr(own, "applyInPandas", lambda self, f, out: sent.append(self._gd1._df.count()) or plain(self, f, out))
    monkeypatch.setattr(E, "TILE", 4)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    if which == "options":
        np.fill_diagonal(cos, 0)
        got = E.dense_cosine_others(d.select(F.col("id").cast("string").alias("article_id"), F.lit("L").alias("acronym"), F.col("label").cast("string").alias("expansion"), "vector"), 8).collect()
        assert len(got) == 270 and all(abs(r["confidence"] - max(0, cos[int(r["article_id"]), int(r["expansion"]) :: 3].max())) < 1e-9 for r in got)
    else:
        np.fill_diagonal(cos, -2)
        v = d.withColumn("block", F.lit(0))
        got = E.nearest(v, v.withColumnRenamed("id", "train_id"), 8).collect()
        assert len(got) == 90 and all(r["train_id"] == cos[r["id"]].round(12).argmax() and r["label"] == r["train_id"] % 3 for r in got)
    assert sent == [90 * 3]  # of 12 blocks


@pytest.mark.parametrize("block_rows", [7, 1500])
def test_cosine_of_all_pairs(spark, block_rows):
    """each pair of a label once, by products of matrices."""
    x = np.random.default_rng(6).normal(size=(60, 5))
    rows = [(k, int(k % 4) if k % 4 else None, v.tolist()) for k, v in enumerate(x)] + [(61, 1, None), (1, 1, x[2].tolist()), (None, 1, x[3].tolist())]
    got = E.cosine_pairs(spark.createDataFrame(rows, "id long, block int, vector array<double>"), block_rows)
    assert "CoGroup" in got._jdf.queryExecution().analyzed().toString()
    cos = lambda v, w: None if v is None or w is None else float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    own = [r for r in rows if None not in r[:2]]
    key = lambda r: (r[0], r[1], r[2] or 0.0)
    want = sorted(((a, b, cos(v, w)) for a, k, v in own for b, m, w in own if k == m and a < b), key=key)
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert len(got) == len(want) and all(g[:2] == w[:2] and (g[2] is w[2] or abs(g[2] - w[2]) < 1e-8) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("name", ["m8_cosine_benchmark", "m8_out_expansion_benchmark"])
def test_folds_run_one_after_the_other(spark, tmp_path, name):
    """what is returned has a row for each fold and no fold's plan."""
    from sparkronym import queries as own

    parts = [(k, f"{'red' if k % 3 else 'raw'} {'sky' if k % 2 else 'salt'}", f"T{k % 4} A", f"B{k % 5}") for k in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = own.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rows = got.collect()
    assert sorted(r["fold"] for r in rows) == list(range(5)) and sum(r["n"] for r in rows) == 60
