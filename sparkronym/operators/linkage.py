"""Expansion linkage: expansions of one acronym that mean the same become one.

Links are between similar expansions of an acronym, and between different expansions of
an acronym in one article. Their connected components are clusters; each gets its
representative. Blocks are acronyms (singular and plural together) and expansions are
made distinct before they are compared, so that popular ones cost no more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkronym.functions.similarity import plain, prefix4
from sparkronym.functions.text import singular_acronym
from sparkronym.operators.dictionary import representatives
from sparkronym.shipping import ship
from sparkronym.storage import Steps


#: Edits between similar expansions at most; of one piece more, one is the same in both.
EDITS = 2


def _pieces(length: Column, k: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of piece k of EDITS + 1 near equal ones of a string."""
    n, size = EDITS + 1, F.floor(length / (EDITS + 1)).cast("int")
    more = length % n  # the last so many pieces have one character more
    return k * size + F.greatest(F.lit(0), k - (n - more)), size + F.when(k >= n - more, 1).otherwise(0)


def near_edits(names: DataFrame) -> DataFrame:
    """(acronym, x, y), x < y: distinct names of an acronym at most EDITS edits apart.

    A name is cut into one piece more than edits; one of them stands in any name so near, at most as many places
    off and in a name at most as much longer. So names meet by (acronym, length, piece, its text), never all with
    all of an acronym, and only who meets is compared."""
    d = names.select("acronym", "name").distinct().withColumn("len", F.length("name"))
    k = F.explode(F.sequence(F.lit(0), F.lit(EDITS))).alias("k")
    start, size = _pieces(F.col("len"), F.col("k"))
    has = d.select("acronym", "name", "len", k).select("acronym", F.col("name").alias("short"), "len", "k", F.col("name").substr(start + 1, size).alias("piece"))
    less = F.explode(F.sequence(F.greatest(F.lit(0), F.col("len") - EDITS), F.col("len"))).alias("other")
    asks = d.select("acronym", "name", "len", less).select("acronym", "name", "len", "other", k)
    start, size = _pieces(F.col("other"), F.col("k"))
    off = F.explode(F.sequence(F.greatest(F.lit(0), start - EDITS), F.least(F.col("len") - size, start + EDITS))).alias("at")
    fits = F.greatest(F.lit(0), start - EDITS) <= F.least(F.col("len") - size, start + EDITS)
    asks = asks.where(fits).select("acronym", "name", F.col("other").alias("len"), "k", size.alias("size"), off)
    asks = asks.select("acronym", "name", "len", "k", F.expr("substr(name, at + 1, size)").alias("piece")).distinct()
    met = asks.join(has, ["acronym", "len", "k", "piece"]).where("name <> short").select("acronym", F.least("name", "short").alias("x"), F.greatest("name", "short").alias("y")).distinct()
    return met.where(F.levenshtein("x", "y", EDITS) >= 0)


def similar_pairs(dictionary: DataFrame) -> DataFrame:
    """(acronym, a, b), a < b: distinct similar expansions of an acronym: equal when plain, of equal word prefixes, or
    at most two edits apart. Each of the three is a join on what both have."""
    d = dictionary.select(singular_acronym("acronym").alias("acronym"), "expansion").distinct().select("*", plain("expansion").alias("plain"))
    d = d.withColumn("prefix", prefix4("plain"))
    a, b = (d.select("acronym", F.col("expansion").alias(x), F.col("plain").alias(f"plain_{x}"), F.col("prefix").alias(f"prefix_{x}")) for x in "ab")
    same = a.join(b.withColumnRenamed("prefix_b", "prefix_a"), ["acronym", "prefix_a"])  # equal when plain: of equal prefixes too
    edits = near_edits(d.select("acronym", F.col("plain").alias("name")))
    both = edits.unionByName(edits.select("acronym", F.col("y").alias("x"), F.col("x").alias("y")))
    near = both.join(a, (a.acronym == both.acronym) & (a.plain_a == both.x)).select(both.acronym, "y", "a")
    near = near.join(b, (b.acronym == near.acronym) & (b.plain_b == near.y)).select(near.acronym, "a", "b")
    return same.select("acronym", "a", "b").unionByName(near).where("a < b").distinct()


def similar_links(dictionary: DataFrame) -> DataFrame:
    """(acronym, a, b): links whose components are those of similar_pairs, but for a group of equal word prefixes only
    one from each to the first."""
    d = dictionary.select(singular_acronym("acronym").alias("acronym"), "expansion").distinct().select("*", plain("expansion").alias("plain"))
    d = d.withColumn("prefix", prefix4("plain"))
    first = lambda c: d.groupBy("acronym", c).agg(F.min("expansion").alias("a"))
    star = d.join(first("prefix"), ["acronym", "prefix"]).where("expansion <> a").select("acronym", "a", F.col("expansion").alias("b"))
    edits, one = near_edits(d.select("acronym", F.col("plain").alias("name"))), first("plain")
    near = edits.join(one.withColumnRenamed("plain", "x"), ["acronym", "x"]).join(one.select("acronym", F.col("plain").alias("y"), F.col("a").alias("b")), ["acronym", "y"])
    return star.unionByName(near.select("acronym", "a", "b"))


def same_article_pairs(dictionary: DataFrame) -> DataFrame:
    """(acronym, a, b): different expansions of an acronym in one article, each linked with the first."""
    d = dictionary.select(singular_acronym("acronym").alias("acronym"), "expansion", "article_id").distinct()
    first = d.groupBy("acronym", "article_id").agg(F.min("expansion").alias("a"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, ["acronym", "article_id"]).where("expansion <> a").select("acronym", "a", F.col("expansion").alias("b")).distinct()


def clusters(dictionary: DataFrame, articles: bool = True) -> DataFrame:
    """(acronym, expansion, cluster): cluster is the smallest expansion of the component.

    Each step takes the smallest label among an expansion and its neighbours and then that
    label's own label, so that chains of any length shorten by halves, until none
    changes; each step is written to the checkpoint folder."""
    links = similar_links(dictionary)
    if articles:
        links = links.unionByName(same_article_pairs(dictionary))
    both = links.unionByName(links.select("acronym", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    steps = Steps(dictionary.sparkSession, "linkage")
    both = steps.cut(both)
    labels = steps.cut(dictionary.select(singular_acronym("acronym").alias("acronym"), "expansion").distinct().withColumn("cluster", F.col("expansion")))
    last = labels
    while True:
        near = both.join(labels.withColumnRenamed("expansion", "b"), ["acronym", "b"]).groupBy("acronym", F.col("a").alias("expansion")).agg(F.min("cluster").alias("near"))
        step = labels.join(near, ["acronym", "expansion"], "left").select("acronym", "expansion", F.col("cluster").alias("old"), F.least("cluster", "near").alias("cluster"))
        over = labels.select("acronym", F.col("expansion").alias("cluster"), F.col("cluster").alias("over"))
        new = steps.cut(step.join(over, ["acronym", "cluster"], "left").select("acronym", "expansion", "old", F.least("cluster", "over").alias("cluster")))
        done = new.where("old <> cluster").isEmpty()
        steps.drop(last)
        last, labels = new, new.drop("old")
        if done:
            steps.drop(both)
            return labels


def link(dictionary: DataFrame, articles: bool = True) -> DataFrame:
    """The dictionary under singular acronyms with representatives for expansions, one row for each article."""
    d = dictionary.withColumn("acronym", singular_acronym("acronym"))
    named = d.join(clusters(dictionary, articles), ["acronym", "expansion"])
    best = representatives(named)
    out = named.join(best, ["acronym", "cluster"]).select("acronym", F.col("representative").alias("expansion"), "article_id", "pos")
    return out.groupBy("acronym", "expansion", "article_id").agg(F.min("pos").alias("pos"))


def greedy_labels(dictionary: DataFrame) -> DataFrame:
    """(acronym, expansion, label): in order of entry, each expansion takes the first earlier label similar to it.

    Not transitive and dependent on order, unlike clusters()."""

    ship(dictionary.sparkSession)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        labels: list[str] = []
        out = []
        for e in rows.sort_values(["pos", "expansion"])["expansion"]:
            found = next((x for x in labels if python_similar(e, x)), None)
            if found is None:
                labels.append(e)
                found = e
            out.append((rows["acronym"].iloc[0], e, found))
        return pd.DataFrame(out, columns=["acronym", "expansion", "label"])

    d = dictionary.groupBy("acronym", "expansion").agg(F.min("pos").alias("pos"))
    return d.groupBy("acronym").applyInPandas(one, "acronym string, expansion string, label string")


def python_similar(a: str, b: str) -> bool:
    x, y = (s.lower().replace("-", " ") for s in (a, b))
    p = [" ".join(w[:4] for w in s.split()) for s in (x, y)]
    return x == y or p[0] == p[1] or _edits(x, y) <= 2


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rewrite_texts(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """Articles (article_id, raw_text) with changed expansions: changes (article_id, old, new)."""
    c = changes.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("old")).alias("k"), "old", "new"))).alias("c"))
    step = lambda t, x: F.replace(t, x["old"], x["new"])
    return articles.join(c, "article_id", "left").select("article_id", F.coalesce(F.aggregate("c", F.col("raw_text"), step), "raw_text").alias("raw_text"))
