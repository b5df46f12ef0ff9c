"""Splits and folds of articles, by a rank of hashes: equal sizes, and reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkronym.functions.text import stable_hash

SEED = 1337
#: Ranges of hashes that are ranked each by itself.
RANGES = 1024


def ranked(articles: DataFrame, seed: int = SEED, id_col: str = "article_id") -> DataFrame:
    """Articles with rank from 1 in the order of a hash, and their number n.

    Ranks are numbers within a range of hashes plus the numbers of ranges before, so that
    no task sorts all articles."""
    a = articles.withColumn("_h", stable_hash(seed, id_col)).withColumn("_r", F.shiftright("_h", 50))
    per = a.groupBy("_r").agg(F.count("*").alias("_c"))
    per = per.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_c").over(W.partitionBy(F.lit(0))))
    own = F.row_number().over(W.partitionBy("_r").orderBy("_h", id_col))
    return a.withColumn("_k", own).join(F.broadcast(per), "_r").withColumn("rank", F.col("_k") + F.col("_before")).drop("_h", "_r", "_k", "_c", "_before")  # RANGES rows


def split(articles: DataFrame, train_share: float = 0.7, seed: int = SEED) -> DataFrame:
    """(article_id, split): int(n * share) articles are train, the others test."""
    r = ranked(articles.select("article_id").distinct(), seed)
    return r.select("article_id", F.when(F.col("rank") <= F.floor(F.col("n") * train_share), "train").otherwise("test").alias("split"))


def folds(articles: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """(article_id, fold): k folds of ceil(n / k) articles; test is fold = i, train the others."""
    r = ranked(articles.select("article_id").distinct(), seed)
    return r.select("article_id", F.floor((F.col("rank") - 1) / F.ceil(F.col("n") / k)).cast("int").alias("fold"))


def placed(rows: DataFrame, order_col: str) -> DataFrame:
    """rows with place, from 1 in the order of the column, which has no nulls; ties by Spark's row number.

    Rows of a hashed sample of about RANGES values cut the order into ranges; places are
    those within a range plus the rows of ranges before, so that no task sorts all."""
    n = max(1, rows.count())
    sample = rows.where(F.pmod(F.xxhash64(order_col), F.lit(max(1, n // RANGES))) == 0).select(order_col).distinct()
    cuts = sorted(r[0] for r in sample.limit(8 * RANGES).collect())  # only where ranges end; any cuts give the same places
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast(f"array<{rows.schema[order_col].dataType.simpleString()}>")
    own = F.size(F.filter(bounds, lambda x: x <= F.col(order_col)))
    a = rows.withColumn("_r", own)
    per = a.groupBy("_r").agg(F.count("*").alias("_c"))
    per = per.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    own = F.row_number().over(W.partitionBy("_r").orderBy(order_col))
    return a.withColumn("_k", own).join(F.broadcast(per), "_r").withColumn("place", (F.col("_k") + F.col("_before")).cast("int")).drop("_r", "_k", "_before")  # a row for each range


def modular_folds(articles: DataFrame, k: int = 5) -> DataFrame:
    """Folds of numbered articles in their order: contiguous runs of ceil(n / k)."""
    n = articles.agg(F.count("*").alias("n"))
    return placed(articles, "article_id").crossJoin(F.broadcast(n)).select("article_id", F.floor((F.col("place") - 1) / F.ceil(F.col("n") / k)).cast("int").alias("fold"))


def realign(rows: DataFrame, fold: DataFrame, k: int, part: str) -> DataFrame:
    """Rows of a fold's train or test articles."""
    wanted = fold.where(F.col("fold") == k) if part == "test" else fold.where(F.col("fold") != k)
    return rows.join(wanted.select("article_id"), "article_id", "left_semi")
