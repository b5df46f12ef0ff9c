"""Ids that come once, over restarts and days; models that are fitted once."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sparkronym.operators.extract import extract
from sparkronym.plans.models import ModelStore, fingerprint
from sparkronym.streaming import ingest as S

COLUMNS = "article_id string, raw_text string, ts string"


def put(spark, path, rows):
    spark.createDataFrame(rows, COLUMNS).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def pairs(df):
    return sorted(map(tuple, df.select("article_id", "acronym", "expansion").collect()))


def test_ids_are_taken_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    first = [("1", "A relational database system (RDS) runs.", "2024-01-01 00:00:00"), ("1", "A later wording of it (LWI) stands.", "2024-01-01 00:00:01"), (None, "The nobody named it (NNI) text.", "2024-01-01 00:00:00")]
    second = [("1", "An old id again (OIA) comes.", "2024-01-04 00:00:00"), ("2", "The common dog (CD) barks.", "2024-01-01 00:00:00")]
    third = [("2", "Something else entirely (SEE) now.", "2024-03-01 00:00:00"), ("3", "The third one here (TOH) is new.", "2023-01-01 00:00:00")]
    for rows in (first, second, third):  # each run starts anew from the checkpoint; ids come days late
        put(spark, folder, rows)
        S.ingest(S.read_articles(spark, folder), out, checkpoint).awaitTermination(240)
    got = pairs(spark.read.parquet(out))
    once = spark.createDataFrame([first[0], second[1], third[1]], COLUMNS)
    assert got == pairs(extract(once, "schwartz_hearst")) and len(got) == 3


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, f"file://{tmp_path}/models")


def table(spark, rows):
    return spark.createDataFrame(rows, "article_id string, term string, n int")


ROWS = [("1", "a", 1), ("2", "b", 2), ("2", None, 2)]


def test_models_are_fitted_once(spark, store):
    fits = []

    def get(rows, **params):
        data = table(spark, rows)

        def fit():
            fits.append(1)
            return {"counts": data.groupBy("term").agg(F.sum("n").alias("n"))}

        return sorted(map(tuple, store.get("counts", data, fit, **params)["counts"].collect()), key=str)

    one = get(ROWS, fold=1, size=3)
    assert get(ROWS[::-1], size=3, fold=1) == one and len(fits) == 1  # neither order of rows nor of parameters counts
    get(ROWS, fold=2, size=3)
    get(ROWS, fold=1, size=4)
    get([*ROWS, ROWS[0]], fold=1, size=3)
    get([("1", "a", 1), ("2", "b", 2), ("2", "", 2)], fold=1, size=3)
    assert len(fits) == 5


def test_models_of_spark(spark, store):
    from pyspark.ml.feature import CountVectorizer

    docs = spark.createDataFrame([(["a", "b"],), (["a"],)], "tokens array<string>")
    fit = lambda: {"model": CountVectorizer(inputCol="tokens", outputCol="v").fit(docs)}
    one, two = (store.get("cv", docs, fit, size=1)["model"] for _ in range(2))
    assert one.vocabulary == two.vocabulary == ["a", "b"]


def test_half_written_models(spark, store, tmp_path):
    data = table(spark, ROWS)
    key = fingerprint(data)

    def killed():
        raise RuntimeError("killed")

    bad = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    for fit in (killed, lambda: {"good": data, "bad": bad}):
        with pytest.raises(Exception):  # noqa: B017
            store.get("m", data, fit)
        assert store.load("m", key) is None
    assert [r["n"] for r in store.get("m", data, lambda: {"good": data.agg(F.sum("n").alias("n"))})["good"].collect()] == [5]
    assert store.clean() >= 1 and store.clean() == 0 and store.load("m", key) is not None
    folder = [p for p in glob.glob(f"{tmp_path}/models/m-*") if os.path.isdir(p)]
    assert len(folder) == 1


def test_another_commits_first(spark, store, tmp_path):
    data = table(spark, ROWS)
    key = fingerprint(data)
    store.save("m", key, {"x": data.limit(1)})
    store.save("m", key, {"x": data})
    assert store.load("m", key)["x"].count() == 1
    assert len([p for p in glob.glob(f"{tmp_path}/models/m-*") if os.path.isdir(p)]) == 1
    shutil.rmtree(tmp_path / "models")
    assert store.load("m", key) is None and store.clean() == 0


def test_fingerprints_of_nothing(spark):
    none = table(spark, [])
    assert fingerprint(none) == fingerprint(none.repartition(3)) != fingerprint(none, fold=0)
