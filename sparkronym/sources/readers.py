"""Readers of the supported corpus formats into the normalised tables.

articles (article_id, raw_text); dictionary (acronym, expansion, article_id, pos); gold
(article_id, acronym, expansion, in_text). Every reader gives its schema; none infers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkronym.functions.text import strip_markup


def stored_map(spark: SparkSession, path: str) -> DataFrame:
    """A table written by sinks.stored_map."""
    return spark.read.parquet(path)


def definitions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scraped definitions: acronym, definition, id."""
    return spark.read.csv(path, header=True, schema="acronym string, definition string, article_id string")


def articles_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="article_id string, raw_text string")


def article_info_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="article_id string, title string, source string")


INFON = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())])
BIOC = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("passage", T.ArrayType(T.StructType([
            T.StructField("infon", T.ArrayType(INFON)), T.StructField("text", T.StringType()),
            T.StructField("annotation", T.ArrayType(T.StructType([T.StructField("_id", T.StringType()), T.StructField("infon", T.ArrayType(INFON)), T.StructField("text", T.StringType())]))),
            T.StructField("relation", T.ArrayType(T.StructType([T.StructField("infon", T.ArrayType(INFON)), T.StructField("node", T.ArrayType(T.StructType([T.StructField("_refid", T.StringType()), T.StructField("_role", T.StringType())])))]))),
        ]))),
    ]
)


def bioc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, gold) of BioC XML: title and abstract; short and long forms joined through ABBR relations."""
    docs = spark.read.format("xml").option("rowTag", "document").schema(BIOC).load(path).withColumnRenamed("id", "article_id")
    p = docs.select("article_id", F.posexplode("passage").alias("k", "p"))
    is_affiliation = F.exists(F.coalesce("p.infon", F.array()), lambda i: F.lower(i["_VALUE"]) == "affiliation")
    texts = p.where(~is_affiliation).groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p.text"))), lambda s: s["text"]), "\n").alias("raw_text"))
    ann = p.select("article_id", F.explode("p.annotation").alias("a")).select("article_id", F.col("a._id").alias("ref"), F.col("a.text").alias("text"))
    rel = p.select("article_id", F.explode("p.relation").alias("r")).where(F.exists("r.infon", lambda i: i["_VALUE"] == "ABBR"))
    node = lambda role: F.filter("r.node", lambda n: n["_role"] == role)[0]["_refid"]
    rel = rel.select("article_id", node("ShortForm").alias("s"), node("LongForm").alias("l"))
    short, long = ann.withColumnsRenamed({"ref": "s", "text": "acronym"}), ann.withColumnsRenamed({"ref": "l", "text": "expansion"})
    gold = rel.join(short, ["article_id", "s"]).join(long, ["article_id", "l"]).select("article_id", "acronym", "expansion", F.lit(True).alias("in_text"))
    return texts, gold


def arff(spark: SparkSession, path: str, senses_path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, dictionary) of one ARFF file for each acronym, whose class names a sense in a TSV."""
    lines = spark.read.text(path).select("value", F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^([^_.]+)", 1)).alias("acronym"))
    rows = lines.where("value <> '' and not startswith(value, '@') and not startswith(value, '%')")
    row = F.from_csv("value", "pmid string, text string, class string", {"escape": "\\"})
    rows = rows.select("acronym", row.alias("r")).select("acronym", "r.*")
    senses = spark.read.csv(senses_path, sep="\t", schema="acronym string, code string, expansion string")
    named = rows.join(senses.select("acronym", F.expr("substring(code, length(acronym) + 1)").alias("class"), "expansion"), ["acronym", "class"])
    return (
        named.select(F.col("pmid").alias("article_id"), strip_markup("text").alias("raw_text")).distinct(),
        named.select("acronym", "expansion", F.col("pmid").alias("article_id"), F.xxhash64("pmid").alias("pos")),
    )


def coded_texts(spark: SparkSession, texts_path: str, senses_path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, dictionary) of plain texts in which a code stands for an expansion: the code becomes its token."""
    t = spark.read.text(texts_path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("article_id"), F.col("value").alias("raw_text"))
    senses = spark.read.csv(senses_path, sep="\t", schema="acronym string, code string, expansion string").withColumn("pos", F.monotonically_increasing_id())
    words = t.select("article_id", F.explode(F.array_distinct(F.split("raw_text", r"\s+"))).alias("code"))
    hit = words.join(senses, "code").groupBy("article_id").agg(F.min_by(F.struct("acronym", "code", "expansion", "pos"), "pos").alias("s")).select("article_id", "s.*")
    token = F.regexp_replace(F.regexp_replace("expansion", r"[^A-Za-z0-9_]", " "), r"\s+", "_")
    articles = t.join(hit, "article_id").select("article_id", F.replace("raw_text", F.col("code"), token).alias("raw_text"))
    return articles, hit.select("acronym", "expansion", "article_id", "pos")


def sgml_news(spark: SparkSession, path: str) -> DataFrame:
    """articles of SGML news: title and body, with lines of a paragraph joined."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<reuters.*?</reuters>"), F.lit(0))).alias("d"))
    part = lambda tag: F.regexp_extract("d", rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    body = F.regexp_replace(F.regexp_replace(part("body"), r"\n(?! {2,})", " "), r" {2,}", " ")
    return raw.select(F.regexp_extract("d", r'(?i)newid="(\d+)"', 1).alias("article_id"), F.trim(F.concat_ws("\n", part("title"), body)).alias("raw_text"))


def disambiguation_json(spark: SparkSession, path: str) -> DataFrame:
    """(acronym, expansion, link, raw_text, k, split) of {acronym: {full_form, link, content, possibilities}}: acronyms
    of two full forms or more; the first is train, the others test."""
    one = "full_form string, link string, content string"
    schema = f"map<string, struct<{one.replace(' string', ': string')}, possibilities: array<struct<{one.replace(' string', ': string')}>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("acronym", "v"))
    first = F.array(F.struct("v.full_form", "v.link", "v.content"))
    flat = rows.select("acronym", F.posexplode(F.concat(first, F.coalesce("v.possibilities", F.array().cast(f"array<struct<{one.replace(' string', ': string')}>>")))).alias("k", "p"))
    out = flat.select("acronym", F.col("p.full_form").alias("expansion"), F.col("p.link").alias("link"), F.col("p.content").alias("raw_text"), "k")
    n = F.size(F.collect_set("expansion").over(W.partitionBy("acronym")))
    return out.withColumn("n", n).where("n >= 2").drop("n").withColumn("split", F.when(F.col("k") == 0, "train").otherwise("test"))


def science_csv(spark: SparkSession, csv_path: str, texts_path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, gold): ids, acronyms and definitions by CSV, texts by files; in_text says whether the definition is
    found in the text, exactly or nearly."""
    rows = spark.read.csv(csv_path, schema="article_id string, acronym string, id string, expansion string")
    texts = spark.read.text(texts_path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("article_id"), F.replace("value", F.lit("-"), F.lit(" ")).alias("raw_text"))
    j = rows.withColumn("expansion", F.replace("expansion", F.lit("-"), F.lit(" "))).join(texts, "article_id")
    return texts.join(rows.select("article_id").distinct(), "article_id", "left_semi"), j.select("article_id", "acronym", "expansion", found_nearly("raw_text", "expansion").alias("in_text"))


def found_nearly(text: str | Column, part: str | Column, cost: int = 2) -> Column:
    """Whether a text holds a phrase, or a run of as many words at most cost edits from it."""
    t, p = F.lower(F.col(text)), F.lower(F.col(part))
    words = F.split(t, r"\s+")
    n = F.size(F.split(p, r"\s+"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return t.contains(p) | F.exists(runs, lambda r: F.levenshtein(r, p, cost) >= 0)


def token_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, dictionary) of [{id, tokens, acronym (a place), expansion}]: the token at the place becomes the expansion's token."""
    rows = spark.read.json(path, multiLine=True, schema="id string, tokens array<string>, acronym int, expansion string")
    token = F.regexp_replace("expansion", " ", "_")
    text = F.array_join(F.transform("tokens", lambda x, i: F.when(i == F.col("acronym"), token).otherwise(x)), " ")
    return (
        rows.select(F.col("id").alias("article_id"), text.alias("raw_text")),
        rows.select(F.get("tokens", F.col("acronym")).alias("acronym"), "expansion", F.col("id").alias("article_id"), F.xxhash64("id").alias("pos")),
    )


def tagged_json(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, tokens, tags) of [{id, tokens, labels}]."""
    rows = spark.read.json(path, multiLine=True, schema="id string, tokens array<string>, labels array<string>")
    return rows.select(F.col("id").alias("article_id"), "tokens", F.col("labels").alias("tags"))


def annotations_csv(spark: SparkSession, path: str, annotators: int = 1) -> DataFrame:
    """gold of an annotators' CSV: title, id, then in-text and out-of-text cells of lines acronym;expansion, two for
    each annotator. Expansions are lower-cased; malformed lines are dropped. With several annotators their numbers,
    from 0, are a column."""
    cells = [(f"inside{k}", f"outside{k}") for k in range(annotators)]
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=", ".join(f"{c} string" for c in ("title", "article_id", *(x for pair in cells for x in pair))))
    each = F.array(*(F.struct(F.col(c).alias("c"), F.lit(c.startswith("in")).alias("in_text"), F.lit(k).alias("annotator")) for k, pair in enumerate(cells) for c in pair))
    lines = rows.select("article_id", F.explode(each).alias("s")).select("article_id", "s.in_text", "s.annotator", F.explode(F.split("s.c", r"\r?\n")).alias("line")).withColumn("p", F.split("line", ";")).where("size(p) = 2")
    out = lines.select("article_id", F.trim(F.col("p")[0]).alias("acronym"), F.lower(F.trim(F.col("p")[1])).alias("expansion"), "in_text", "annotator").where("acronym <> '' and expansion <> ''")
    return out if annotators > 1 else out.drop("annotator")


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, url, title, raw_text) of folders of <doc id url title> files."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    docs = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<doc [^>]*>.*?</doc>"), F.lit(0))).alias("d"))
    attr = lambda a: F.regexp_extract("d", rf'^<doc [^>]*\b{a}="([^"]*)"', 1)
    return docs.select(attr("id").alias("article_id"), attr("url").alias("url"), attr("title").alias("title"), F.regexp_replace(F.regexp_extract("d", r"(?s)^<doc [^>]*>(.*)</doc>$", 1), r"^\s+|\s+$", "").alias("raw_text"))


def wiki_wanted(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Only wanted articles of a dump: by id (a column article_id) or by title (a column title, of any case, with
    underscores for spaces or not)."""
    dump = wiki_dump(spark, path)
    if "article_id" in wanted.columns:
        return dump.join(wanted.select("article_id").distinct(), "article_id", "left_semi")
    name = lambda c: F.lower(F.trim(F.replace(c, F.lit("_"), F.lit(" "))))
    return dump.withColumn("name", name(F.col("title"))).join(wanted.select(name(F.col("title")).alias("name")).distinct(), "name", "left_semi").drop("name")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, raw_text) of HTML and text files by their ending; others are left out."""
    from sparkronym.operators.links import page_texts

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("article_id"), F.col("value").alias("html"))
    plain = files.where(F.lower("article_id").rlike(r"\.(txt|text)$")).select("article_id", F.col("html").alias("raw_text"))
    return plain.unionByName(page_texts(files.where(F.lower("article_id").rlike(r"\.x?html?$"))))


def confidences_csv(spark: SparkSession, path: str) -> DataFrame:
    """(expander, fold, article_id, acronym, expansion, confidence) of CSVs, one for each expander, by their file names."""
    rows = spark.read.csv(path, header=True, escape='"', schema="fold string, doc_id string, acronym string, confidences_json_dict string").select("*", F.col("_metadata.file_name").alias("_f"))
    name = F.regexp_extract("_f", r"^confidences_(.+)\.csv$", 1)
    m = F.from_json("confidences_json_dict", "map<string, double>")
    return rows.select(name.alias("expander"), "fold", F.col("doc_id").alias("article_id"), "acronym", F.explode(m).alias("expansion", "confidence"))


def word_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


#: Extension surface: readers by name.
REGISTRY = {f.__name__: f for f in (stored_map, definitions_csv, articles_csv, article_info_csv, bioc, arff, coded_texts, sgml_news, disambiguation_json, science_csv, token_json, tagged_json, annotations_csv, wiki_dump, html_files, confidences_csv, word_set)}
