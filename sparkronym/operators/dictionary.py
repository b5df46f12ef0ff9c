"""The dictionary of acronyms: rows (acronym, expansion, article_id, pos), pos their order of entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkronym.functions.similarity import prefix4
from sparkronym.functions.text import singular_acronym

#: Confidence of an answer that had no rival.
SINGLE_OPTION = -5.0


def nested(dictionary: DataFrame) -> DataFrame:
    """acronym -> its (expansion, article_id) in order, repeats kept."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "expansion", "article_id")))
    return dictionary.groupBy("acronym").agg(F.transform(entries, lambda e: F.struct(e["expansion"].alias("expansion"), e["article_id"].alias("article_id"))).alias("entries"))


def by_article(dictionary: DataFrame) -> DataFrame:
    """The inverse: one expansion for each article and acronym, the last entered."""
    return dictionary.groupBy("article_id", "acronym").agg(F.max_by("expansion", F.struct("pos", "expansion")).alias("expansion"))


def article_maps(dictionary: DataFrame) -> DataFrame:
    return by_article(dictionary).groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("acronym", "expansion")))).alias("expansions"))


def merge(*parts: DataFrame) -> DataFrame:
    """Dictionaries one after the other."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def options(dictionary: DataFrame) -> DataFrame:
    """acronym -> its distinct expansions and their number."""
    return dictionary.groupBy("acronym").agg(F.array_sort(F.collect_set("expansion")).alias("options")).withColumn("n_options", F.size("options"))


def candidates(mentions: DataFrame, dictionary: DataFrame, plural: bool = False) -> DataFrame:
    """mentions (with acronym) by the dictionary's entries of the acronym; acronyms not in it are left out.

    plural: entries of the acronym without its final s count too."""
    d = dictionary.select(F.col("acronym").alias("_key"), F.col("expansion").alias("option"), F.col("article_id").alias("train_id"), "pos")
    if not plural:
        return mentions.join(d, mentions["acronym"] == d["_key"]).drop("_key")
    keys = mentions.withColumn("_k", F.explode(F.array_distinct(F.array("acronym", singular_acronym("acronym")))))
    return keys.join(d, keys["_k"] == d["_key"]).drop("_k", "_key")


def candidate_counts(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(acronym, option, n): how many rows candidates() has of each, without making them: mentions of the acronym times
    entries of the option."""
    m = mentions.groupBy("acronym").agg(F.count("*").alias("_m"))
    d = dictionary.groupBy("acronym", F.col("expansion").alias("option")).agg(F.count("*").alias("_d"))
    return m.join(d, "acronym").select("acronym", "option", (F.col("_m") * F.col("_d")).alias("n"))


def gate(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """mentions with options and n_options; answered at once where there is one: expansion and its confidence.

    This filter stands before any vectors are made: only mentions of several options go on."""
    o = options(dictionary)
    out = mentions.join(o, "acronym")
    one = F.col("n_options") == 1
    return out.withColumn("expansion", F.when(one, F.col("options")[0])).withColumn("confidence", F.when(one, F.lit(SINGLE_OPTION)))


def most_frequent(dictionary: DataFrame) -> DataFrame:
    """acronym -> its most frequent expansion, of equals the first entered, and its share."""
    counts = dictionary.groupBy("acronym", "expansion").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    per = W.partitionBy("acronym")
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(per)).withColumn("rank", F.row_number().over(per.orderBy(F.desc("n"), "first", "expansion")))
    return ranked.where("rank = 1").select("acronym", "expansion", F.col("share").alias("confidence"))


def representatives(clusters: DataFrame) -> DataFrame:
    """Of each (acronym, cluster): the most frequent expansion, of equals the longest, then the first by text."""
    counts = clusters.groupBy("acronym", "cluster", "expansion").agg(F.count("*").alias("n"))
    per = W.partitionBy("acronym", "cluster").orderBy(F.desc("n"), F.desc(F.length("expansion")), "expansion")
    return counts.withColumn("rank", F.row_number().over(per)).where("rank = 1").select("acronym", "cluster", F.col("expansion").alias("representative"))


def frequency_stats(dictionary: DataFrame) -> DataFrame:
    """Per expansion: counts of its acronym and of itself, its share, the acronym's length."""
    c = dictionary.groupBy("acronym", "expansion").agg(F.count("*").alias("expansion_count"))
    c = c.withColumn("acronym_count", F.sum("expansion_count").over(W.partitionBy("acronym")))
    return c.select("acronym", "expansion", "acronym_count", "expansion_count", (F.col("expansion_count") / F.col("acronym_count")).alias("exp_freq"), F.length("acronym").alias("acronym_len"))


def corpus_stats(dictionary: DataFrame) -> DataFrame:
    """One row: articles, acronyms, expansions, ambiguous acronyms, and means."""
    per_acronym = dictionary.groupBy("acronym").agg(F.countDistinct("expansion").alias("n"), F.count("*").alias("rows"))
    per_article = dictionary.groupBy("article_id").agg(F.countDistinct("acronym").alias("n"))
    a = per_acronym.agg(
        F.count("*").alias("n_acronyms"), F.sum("n").alias("n_expansions"), F.sum((F.col("n") > 1).cast("int")).alias("n_ambiguous"),
        F.avg("n").alias("expansions_per_acronym"), F.avg(F.when(F.col("n") > 1, F.col("n"))).alias("expansions_per_ambiguous"),
    )
    return per_article.agg(F.count("*").alias("n_articles"), F.avg("n").alias("acronyms_per_article")).crossJoin(a)  # one row by one row


def runs(definitions: DataFrame) -> DataFrame:
    """Scraped definitions (acronym, definition) in runs: sorted, each run begins where the words' first four
    characters differ from those of the run's first definition."""
    plain = F.trim(F.replace(F.lower(F.col("definition")), F.lit("-"), F.lit(" ")))
    d = definitions.select("acronym", plain.alias("expansion")).distinct().withColumn("p4", prefix4("expansion"))
    # equal prefixes are one run and stand together in the order by prefix
    first = d.groupBy("acronym", "p4").agg(F.min("expansion").alias("head"), F.count("*").alias("n_definitions"))
    per = W.partitionBy("acronym").orderBy("head", "p4")
    return first.select("acronym", F.col("head").alias("expansion"), "n_definitions", F.row_number().over(per).alias("run"))


def drop_null(pairs: DataFrame) -> DataFrame:
    return pairs.where("expansion is not null")


def keep_ids(rows: DataFrame, ids: DataFrame, prefix: str | None = None) -> DataFrame:
    """Rows of the wanted articles; ids of a data set may get its prefix."""
    out = rows.join(ids.select("article_id").distinct(), "article_id", "left_semi")
    return out if prefix is None else out.withColumn("article_id", F.concat(F.lit(prefix), F.col("article_id")))


def leaks(train: DataFrame, test: DataFrame) -> DataFrame:
    """Articles that are in both; there should be none."""
    return train.select("article_id").distinct().join(test.select("article_id").distinct(), "article_id")


def in_text_only(gold: DataFrame) -> DataFrame:
    """Expansions that are in the text; the others as null."""
    return gold.withColumn("expansion", F.when(F.col("in_text"), F.col("expansion"))).drop("in_text")


def drop_stop_words(pairs: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Pairs whose expansion is no stop word (column word)."""
    return pairs.join(stop_words.select(F.lower("word").alias("_w")).distinct(), F.lower("expansion") == F.col("_w"), "left_anti")


def drop_roman(pairs: DataFrame) -> DataFrame:
    from sparkronym.functions.acronyms import is_roman

    return pairs.where(~is_roman("acronym"))


def merge_plurals(dictionary: DataFrame) -> DataFrame:
    """Acronyms with a final lower-case s under their singular, whether or not the singular is there."""
    return dictionary.withColumn("acronym", singular_acronym("acronym"))


def three_way(dictionary: DataFrame, wiki: DataFrame, site: DataFrame) -> DataFrame:
    """Each (acronym, expansion) with where it is listed: wiki, site or neither."""
    mark = lambda df, name: df.select("acronym", F.lower("expansion").alias("_e")).distinct().withColumn(name, F.lit(True))
    d = dictionary.select("acronym", "expansion").distinct().withColumn("_e", F.lower("expansion"))
    out = d.join(mark(wiki, "w"), ["acronym", "_e"], "left").join(mark(site, "s"), ["acronym", "_e"], "left")
    return out.select("acronym", "expansion", F.when(F.col("w"), "wiki").when(F.col("s"), "site").otherwise("neither").alias("listed"))
