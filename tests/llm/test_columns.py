"""Every operator and pipeline stage on rows with nulls, repeats, empty and long texts and columns named like the operators' own."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkronym.llm import bpe, embeddings, exact_dedup, jaccard, lines, mixing, sharding, substrings, toxicity, warc
from sparkronym.llm.common import Scratch

OWN = "_id _n _k _c _b _r _text _sha _d y h t id key text_of of a b score size row label n shard slot gone num at to c m old rep kept sha other target class rate n_copies".split()


def rows():
    r = random.Random(11)
    say = lambda n: " ".join(f"w{r.randrange(80)}" for _ in range(n))
    base = say(90)
    text = [None, "", " \n", "a", base, base, base + " z", base.upper(), say(9000), say(60) + " " + base, *(say(30) for _ in range(25)), "idiot " + say(20)]
    out = [(i if i % 7 else None, t) for i, t in enumerate(text)]
    return out + [(4, base), (4, base), (4, say(5)), (None, None), (None, base)]


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(rows())], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    extra = plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(OWN)))
    labels = spark.createDataFrame([(i, int(i % 5 == 1), 1, 2) for i in range(40)] + [(None, 1, 1, 2), (3, None, 1, 2), (3, 1, 1, 2), (99, 0, 1, 2)], "doc_id long, toxic int, y int, t int")
    return plain, extra, labels


def bag(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


READ = {
    "op2": lambda d, _: jaccard.near_duplicates(d, 3, 90),
    "op4": lambda d, _: substrings.remove_repeats(d, window=20),
    "op5": lambda d, _: lines.drop_lines(d),
    "op6": lambda d, y: toxicity.score(d, toxicity.train(d, y), keep=["doc_id", "text"], out_col="mark"),
    "op7": lambda d, _: bpe.encode(d, *bpe.public(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"]),
    "op8": lambda d, _: sharding.reshard(d, 3, "bytes", n_old=2),
    "op8 rows": lambda d, _: sharding.reshard(d, 3, "rows", n_old=2),
    "op8 key": lambda d, _: sharding.reshard(d, 3, "key"),
    "op9": lambda d, _: mixing.mix(d, mixing.targets),
    "op10": lambda d, _: exact_dedup.exact_groups(d),
}


@pytest.mark.parametrize("name", READ)
def test_other_columns_change_nothing(tables, name):
    plain, extra, labels = tables
    got = READ[name](extra, labels)
    assert got.count() == plain.count()
    assert bag(got, *got.columns) == bag(READ[name](plain, labels), *got.columns)


@pytest.mark.parametrize("name", READ)
def test_empty_tables(tables, name):
    plain, extra, labels = tables
    assert READ[name](extra.where("false"), labels.where("false")).count() == 0


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, tables, tmp_path, stage):
    plain, extra, labels = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, extra, str(tmp_path))
    assert got.columns == extra.columns
    assert bag(got, *plain.columns) == bag(run(spark, plain, str(tmp_path)), *plain.columns)
    assert {x for x in bag(got, *extra.columns)} <= {x for x in bag(extra, *extra.columns)}
    assert run(spark, extra.where("false"), str(tmp_path)).count() == 0


def test_last_stage(spark, tables, tmp_path):
    plain, extra, _ = tables
    run = dict(corpus_pipeline.STAGES)["byte-level BPE"]
    assert run(spark, extra, str(tmp_path)).count() == plain.count() and run(spark, extra.where("false"), str(tmp_path)).count() == 0


def test_exact_dedup_keeps_one_row_of_each_text(tables):
    _, extra, _ = tables
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = exact_dedup.drop_copies(extra).collect()
    assert sorted(norm(r["text"]) for r in got) == sorted({norm(t) for _, t in rows()})
    least = {}
    for i, t in rows():
        least[norm(t)] = min(least.get(norm(t), (True, 0)), (i is None, i or 0))
    assert all(((r["doc_id"] is None, r["doc_id"] or 0)) == least[norm(r["text"])] for r in got)


def test_encode_and_score_with_such_columns(tables):
    _, extra, labels = tables
    got = bpe.encode(extra, *bpe.public(), outputs=("ids",))
    assert got.columns == [c for c in extra.columns if c != "text"] + ["ids"]
    back = bpe.decode(got, bpe.public()[0], out_col="again")
    assert sorted(r["again"] for r in back.collect()) == sorted(r["text"] or "" for r in extra.collect())
    assert toxicity.score(extra, toxicity.train(extra, labels)).columns == [c for c in extra.columns if c != "score"] + ["score"]


def test_store_with_such_columns(spark, tables, tmp_path):
    _, extra, _ = tables
    d = extra.drop("shard")
    root = str(tmp_path / "s")
    sharding.store(d, root, sharding.dealt_by_id("doc_id", 2))
    own = lambda: sharding.read_store(spark, root, d.schema)
    sharding.rewrite(spark, root, d.schema, sharding.plan(Scratch(spark, "t"), own(), 3, "rows", F.col("shard"), 2))
    assert bag(own(), *d.columns) == bag(d, *d.columns)
    n = sorted(r["count"] for r in own().groupBy("shard").count().collect())
    assert max(n) - min(n) <= 1 and len(n) == 3


def test_pages_and_vectors_with_such_columns(spark):
    s = Scratch(spark, "t")
    own = [F.lit(1).alias(c) for c in OWN]
    pages = spark.createDataFrame([(i % 5 or None, f"http://h/{i % 3}" if i % 4 else None, "p" * (i % 6)) for i in range(30)], "page_id long, url string, html string")
    found = []
    for k, d in enumerate((pages, pages.select("*", *own))):
        a = warc.Archive(spark, s.path(f"store{k}"))
        a.write(d, s)
        found.append(bag(a.lookup(d), "page_id", "url", "payload_digest", "record_type", "refers_to"))
    assert found[0] == found[1] and len(found[0]) == 30
    vectors = spark.createDataFrame([(i % 9 or None, [float(i % 4), 1.0, -1.0]) for i in range(30)] + [(50, None)], "vec_id long, embedding array<double>")
    got = embeddings.near_vectors(vectors.select("*", *own))
    assert bag(got, *got.columns) == bag(embeddings.near_vectors(vectors), *got.columns) and got.count() == 31


def test_wide_vectors_take_the_same_path(spark):
    """More dimensions than rows: the principal directions are found alike."""
    import numpy as np

    r = np.random.default_rng(2)
    v = r.normal(size=(12, 1500))
    v = [*v, *(v[:4] + 0.01 * r.normal(size=(4, 1500)))]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_vectors(d).collect()}
    assert got == {i: i % 12 for i in range(16)}
