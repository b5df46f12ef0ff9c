"""Masked test texts, numbers as Python reads them, nearest vectors in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkronym.functions import text as X
from sparkronym.operators import expanders as E
from sparkronym.plans import expand as P


def test_numbers_like_python(spark):
    words = ["1", "-1.5", "+.5", "1.", ".", "", "1e5", "1E-3", "1e", "e5", "1_000", "1__0", "_1", "1_", "inf", "-Infinity", "nAn", "infinit", " 7\t", "1 2", "1f", "1d", "0x1", "1,5", "1e1_0", "1_.5", "１２"]

    def python(w):
        try:
            float(w)
        except ValueError:
            return False
        return True

    got = {r["w"]: r["n"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.is_number("w").alias("n")).collect()}
    assert got == {w: python(w) for w in words}


def test_masked_texts(spark):
    a = spark.createDataFrame([("1", "a red_dwarf and a Rapid_Design of RD"), ("2", "nothing here"), ("3", None), ("4", "red_dwarf"), ("5", "no gold")], "article_id string, raw_text string")
    gold = [("1", "RD", "red dwarf"), ("1", "RPD", "Rapid Design"), ("1", "ZZ", "not there"), ("2", "RD", "red dwarf"), ("3", "RD", "red dwarf"), ("4", "RD", "red dwarf"), ("4", "RED", "red dwarf"), ("4", "X", None)]
    texts, left = P.masked(a, spark.createDataFrame(gold, "article_id string, acronym string, expansion string"))
    assert sorted(map(tuple, texts.collect())) == [("1", "a RD and a RPD of RD"), ("4", "RD")]
    assert sorted(map(tuple, left.collect())) == [("1", "RD", "red dwarf"), ("1", "RPD", "Rapid Design"), ("4", "RD", "red dwarf")]


@pytest.mark.parametrize("rows", [4096, 7])
def test_nearest_like_all_pairs(spark, rows):
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (40, 3)).astype(float)  # ties, copies and zeros
    d = spark.createDataFrame([(i, i % 2, f"l{i % 5}", x.tolist()) for i, x in enumerate(v)], "train_id long, block int, label string, vector array<double>")
    got = {x["id"]: (x["train_id"], x["label"], round(x["cos"], 9)) for x in E.nearest(d.select(F.col("train_id").alias("id"), "block", "vector"), d, rows).collect()}
    unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
    cos = (unit @ unit.T).round(12)
    for i in range(40):
        others = [j for j in range(40) if j != i and j % 2 == i % 2]
        j = min(others, key=lambda j: (-cos[i, j], j))
        assert got[i] == (j, f"l{j % 5}", round(float(cos[i, j]), 9))
