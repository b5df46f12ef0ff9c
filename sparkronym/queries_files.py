"""Queries that write the tables' rows in each supported format, read them back through the format's reader, and
compare with SQL. Files go to the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.operators import metrics as M
from sparkronym.queries import CHOICES, DICT, chosen, dictionary, t
from sparkronym.sources import readers as R
from sparkronym.sources import sinks as K
from sparkronym.storage import Steps

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, sql
        return fn

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{Steps(spark, 'files').root}/{name}"


def lines(df: DataFrame, line: Column, path: str) -> str:
    df.select(line.alias("value")).write.text(path)
    return path


def wholes(df: DataFrame, whole: Column, path: str, by: str = "bucket") -> str:
    """A file of one line for each value of a column."""
    df.groupBy(by).agg(whole.alias("value")).write.partitionBy(by).text(path)
    return path


def named(df: DataFrame, line: Column, name: str, ending: str, path: str) -> str:
    """A file for each value of a column, named by it: at most one for each acronym or name."""
    spark = df.sparkSession
    df.select(line.alias("value"), F.col(name).alias("file")).repartition("file").write.partitionBy("file").text(f"{path}-parts")
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(made(path))
    for d in fs.listStatus(made(f"{path}-parts")):
        if d.isDirectory():
            for f in fs.listStatus(d.getPath()):
                if f.getPath().getName().startswith("part-") and not fs.rename(f.getPath(), made(f"{path}/{d.getPath().getName().partition('=')[2]}{ending}")):
                    raise OSError(f"{path}: a file can't be renamed")
    return path


def bare(articles: DataFrame) -> DataFrame:
    """Texts without the line end that closes a file."""
    return articles.withColumn("raw_text", F.regexp_replace("raw_text", r"^\s+|\s+$", ""))


def parts(spark, sf) -> DataFrame:
    p = t(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return dictionary(spark, sf).join(p, F.col("pos") == F.col("p_partkey")).withColumn("bucket", F.col("pos") % 8)


def names(spark, sf) -> DataFrame:
    """Each part's name with its acronym, its number among the acronym's names, and how many parts have it."""
    from pyspark.sql import Window

    d = dictionary(spark, sf).groupBy("acronym", "expansion").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("acronym").orderBy("expansion"))).withColumn("file", F.replace("expansion", F.lit(" "), F.lit("-")))


PARTS = f"WITH {DICT}, pt AS (SELECT dict.*, p_type, p_brand, p_size, pos % 8 AS bucket FROM dict JOIN part ON pos = p_partkey)"
NAMES = f"WITH {DICT}, nm AS (SELECT acronym, expansion, n, first, row_number() OVER (PARTITION BY acronym ORDER BY expansion) AS k, replace(expansion, ' ', '-') AS file FROM (SELECT acronym, expansion, count(*) AS n, min(pos) AS first FROM dict GROUP BY 1, 2))"


# -- tables and CSV ------------------------------------------------------------------------------------


@query(f"WITH {DICT} SELECT * FROM dict")
def s1_k1_stored_map_file(spark, sf):
    path = folder(spark, "map")
    K.stored_map(dictionary(spark, sf), path, "acronym")
    return R.stored_map(spark, path)


@query(f"WITH {DICT} SELECT acronym, expansion AS definition, article_id FROM dict")
def s2_definitions_file(spark, sf):
    path = folder(spark, "definitions")
    dictionary(spark, sf).select("acronym", F.col("expansion").alias("definition"), "article_id").write.csv(path, header=True, escape='"')
    return R.definitions_csv(spark, path)


@query(f"{PARTS} SELECT article_id, 'The \"' || expansion || '\", a part' || chr(10) || 'of type ' || p_type AS raw_text FROM pt")
def s3_articles_file(spark, sf):
    """Texts with quotation marks, commas and line ends."""
    path = folder(spark, "articles")
    text = F.concat(F.lit('The "'), "expansion", F.lit('", a part\nof type '), "p_type")
    parts(spark, sf).select("article_id", text.alias("raw_text")).write.csv(path, header=True, escape='"')
    return R.articles_csv(spark, path)


@query(f"{PARTS} SELECT article_id, expansion AS title, p_brand AS source FROM pt")
def s4_article_info_file(spark, sf):
    path = folder(spark, "info")
    parts(spark, sf).select("article_id", F.col("expansion").alias("title"), F.col("p_brand").alias("source")).write.csv(path, header=True, escape='"')
    return R.article_info_csv(spark, path)


@query(
    f"""{PARTS}, c AS (SELECT pt.*, p_partkey FROM pt JOIN part ON pos = p_partkey), a AS (
    SELECT article_id, acronym, expansion, true AS in_text, 0 AS annotator FROM c WHERE p_partkey % 3 < 2 UNION ALL SELECT article_id, 'X' || p_size, lower(p_brand), false, 0 FROM c
    UNION ALL SELECT article_id, acronym, expansion, true, 1 FROM c UNION ALL SELECT article_id, 'Y', lower(p_type), false, 1 FROM c WHERE p_size > 25) SELECT * FROM a"""
)
def s13_two_annotators_file(spark, sf):
    k, pair = F.col("pos") % 3, F.concat_ws(";", "acronym", "expansion")
    inside = F.when(k == 0, pair).when(k == 1, F.concat(F.lit("no pair\n"), "acronym", F.lit(";"), F.upper("expansion")))
    other = F.when(F.col("p_size") > 25, F.concat(F.lit("Y;"), "p_type"))
    path = folder(spark, "annotations")
    rows = parts(spark, sf).select(F.col("expansion").alias("title"), "article_id", inside.alias("in0"), F.concat(F.lit("X"), "p_size", F.lit(";"), "p_brand").alias("out0"), pair.alias("in1"), other.alias("out1"))
    rows.write.csv(path, header=True, escape='"')
    return R.annotations_csv(spark, path, annotators=2)


@query(f"{NAMES} SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(expansion, ' ')) AS w FROM nm)")
def s20_word_set_file(spark, sf):
    words = dictionary(spark, sf).select(F.explode(F.split("expansion", " ")).alias("w"))
    return R.word_set(spark, lines(words, F.concat(F.lit(" "), F.upper("w")), folder(spark, "words")))


# -- marked-up texts ---------------------------------------------------------------------------------


@query(f"{PARTS} SELECT article_id, 'The ' || expansion || ' (' || acronym || ')' || chr(10) || p_type AS raw_text, acronym, expansion FROM pt")
def s5_j13_bioc_file(spark, sf):
    say = lambda key, value: f'<infon key="{key}">{value}</infon>'
    mark = lambda ref, form, c: [F.lit(f'<annotation id="{ref}">{say("type", "ABBR")}{say("ABBR", form)}<text>'), F.col(c), F.lit("</text></annotation>")]
    doc = [F.lit("<document><id>"), F.col("article_id"), F.lit(f"</id><passage>{say('type', 'title')}<text>The "), F.col("expansion"), F.lit(" ("), F.col("acronym"), F.lit(")</text>")]
    doc += [*mark("L1", "LongForm", "expansion"), *mark("S1", "ShortForm", "acronym"), F.lit(f'<relation id="R1">{say("type", "ABBR")}<node refid="L1" role="LongForm"/><node refid="S1" role="ShortForm"/></relation></passage>')]
    doc += [F.lit(f"<passage>{say('type', 'abstract')}<text>"), F.col("p_type"), F.lit("</text></passage></document>")]
    whole = F.concat(F.lit("<collection>"), F.array_join(F.collect_list(F.concat(*doc)), "\n"), F.lit("</collection>"))
    texts, gold = R.bioc(spark, wholes(parts(spark, sf), whole, folder(spark, "bioc")))
    return texts.join(gold, "article_id").select("article_id", "raw_text", "acronym", "expansion")


@query(f"{NAMES} SELECT CAST(pos AS VARCHAR) AS article_id, 'We use ' || acronym || ' of it' AS raw_text, acronym, dict.expansion FROM dict JOIN nm USING (acronym, expansion)")
def s6_j14_arff_files(spark, sf):
    """A file for each acronym, with a class for each of its names."""
    n = names(spark, sf)
    senses = folder(spark, "senses")
    n.select("acronym", F.concat("acronym", F.lit("M"), "k"), "expansion").write.csv(senses, sep="\t")
    rows = dictionary(spark, sf).join(n.select("acronym", "expansion", "k"), ["acronym", "expansion"])
    line = F.concat(F.col("article_id"), F.lit(',"We use <e>'), F.col("acronym"), F.lit('</e> of it",M'), F.col("k"))
    texts, d = R.arff(spark, named(rows, line, "acronym", "_pmids.arff", folder(spark, "arff")), senses)
    return texts.join(d.select("article_id", "acronym", "expansion"), "article_id")


@query(f"{NAMES} SELECT file AS article_id, 'we use ' || replace(expansion, ' ', '_') || ' in ' || n || ' parts' AS raw_text, acronym, expansion FROM nm")
def s7_coded_text_files(spark, sf):
    n = names(spark, sf)
    senses, code = folder(spark, "codes"), F.concat("acronym", F.lit("M"), "k")
    n.select("acronym", code, "expansion").write.csv(senses, sep="\t")
    texts, d = R.coded_texts(spark, named(n, F.concat(F.lit("we use "), code, F.lit(" in "), "n", F.lit(" parts")), "file", ".txt", folder(spark, "texts")), senses)
    return bare(texts).join(d.select("article_id", "acronym", "expansion"), "article_id")


@query(f"{PARTS} SELECT article_id, upper(expansion) || chr(10) || 'It is ' || p_type || ' and ' || p_brand AS raw_text FROM pt")
def s8_news_file(spark, sf):
    doc = F.concat(F.lit('<REUTERS TOPICS="YES" NEWID="'), "article_id", F.lit('"><TEXT><TITLE>'), F.upper("expansion"), F.lit("</TITLE><BODY>It is\n"), "p_type", F.lit(" and\n"), "p_brand", F.lit("</BODY></TEXT></REUTERS>"))
    return R.sgml_news(spark, lines(parts(spark, sf), doc, folder(spark, "news")))


@query(f"{PARTS} SELECT article_id, 'https://w/' || article_id AS url, expansion AS title, 'About ' || p_type || chr(10) || 'and ' || p_brand AS raw_text FROM pt WHERE p_size <= 10")
def s14_s15_wiki_by_id(spark, sf):
    p = parts(spark, sf)
    return R.wiki_wanted(spark, _wiki(spark, p), p.where("p_size <= 10").select("article_id"))


def _wiki(spark, p: DataFrame) -> str:
    doc = F.concat(F.lit('<doc id="'), "article_id", F.lit('" url="https://w/'), "article_id", F.lit('" title="'), "expansion", F.lit('">\nAbout '), "p_type", F.lit("\nand "), "p_brand", F.lit("\n</doc>"))
    return lines(p, doc, folder(spark, "wiki"))


@query(f"{PARTS} SELECT article_id, 'https://w/' || article_id AS url, expansion AS title, 'About ' || p_type || chr(10) || 'and ' || p_brand AS raw_text FROM pt WHERE acronym[1] < 'M'")
def s15_wiki_by_title(spark, sf):
    p = parts(spark, sf)
    wanted = p.where(F.substring("acronym", 1, 1) < "M").select(F.replace(F.initcap("expansion"), F.lit(" "), F.lit("_")).alias("title"))
    return R.wiki_wanted(spark, _wiki(spark, p), wanted)


@query(f"{NAMES} SELECT file || CASE WHEN k = 1 THEN '.html' ELSE '.txt' END AS article_id, CASE WHEN k = 1 THEN 'Of ' || acronym || ' there are ' || n ELSE '<b>' || expansion || '</b>' END AS raw_text FROM nm")
def s17_html_files(spark, sf):
    n, path = names(spark, sf), folder(spark, "pages")
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p>Of <b>"), "acronym", F.lit("</b> there are "), "n", F.lit("</p><script>no</script></body></html>"))
    named(n.where("k = 1"), page, "file", ".html", path)
    named(n.where("k > 1"), F.concat(F.lit("<b>"), "expansion", F.lit("</b>")), "file", ".txt", f"{path}2")
    both = R.html_files(spark, path).unionByName(R.html_files(spark, f"{path}2"))
    return bare(both)


@query(f"{NAMES} SELECT file AS article_id, acronym, expansion, k = 1 AS in_text FROM nm")
def s10_science_files(spark, sf):
    """Definitions by CSV, found in the texts or not."""
    n, csv = names(spark, sf), folder(spark, "science")
    n.select("file", "acronym", "first", F.replace("expansion", F.lit(" "), F.lit("-"))).write.csv(csv, escape='"')
    text = F.when(F.col("k") == 1, F.concat(F.lit("It was a "), F.upper("expansion"), F.lit(" survey"))).otherwise(F.lit("0 1 2 3"))
    return R.science_csv(spark, csv, named(n, text, "file", ".txt", folder(spark, "abstracts")))[1]


# -- JSON -----------------------------------------------------------------------------------------------


@query(f"{NAMES} SELECT a.acronym, a.expansion, 'l' || a.first AS link, a.n || ' of it' AS raw_text, (a.k - 1)::INT AS k, CASE WHEN a.k = 1 THEN 'train' ELSE 'test' END AS split FROM nm a JOIN (SELECT acronym FROM nm GROUP BY 1 HAVING count(*) > 1) USING (acronym)")
def s9_disambiguation_file(spark, sf):
    one = F.struct(F.col("expansion").alias("full_form"), F.concat(F.lit("l"), "first").alias("link"), F.concat("n", F.lit(" of it")).alias("content"))
    forms = names(spark, sf).groupBy("acronym").agg(F.array_sort(F.collect_list(F.struct("k", one.alias("one")))).alias("f")).withColumn("bucket", F.ascii("acronym") % 4)
    first = F.col("f")[0]["one"]
    entry = F.struct(first["full_form"].alias("full_form"), first["link"].alias("link"), first["content"].alias("content"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x["one"]).alias("possibilities"))
    return R.disambiguation_json(spark, wholes(forms, F.to_json(F.map_from_entries(F.collect_list(F.struct("acronym", entry)))), folder(spark, "senses")))


@query(f"{PARTS} SELECT article_id, 'see ' || replace(expansion, ' ', '_') || ' of ' || p_type AS raw_text, acronym, expansion FROM pt")
def s11_token_file(spark, sf):
    row = F.struct(F.col("article_id").alias("id"), F.array(F.lit("see"), "acronym", F.lit("of"), "p_type").alias("tokens"), F.lit(1).alias("acronym"), "expansion")
    texts, d = R.token_json(spark, wholes(parts(spark, sf), F.to_json(F.collect_list(row)), folder(spark, "tokens")))
    return texts.join(d.select("article_id", "acronym", "expansion"), "article_id")


@query(f"{PARTS} SELECT article_id, 'The ' || expansion || ' ( ' || acronym || ' )' AS tokens, array_to_string(list_concat(['O', 'B-long'], ['I-long' FOR x IN range(2, len(string_split(expansion, ' ')) + 1)], ['O', 'B-short', 'O']), ' ') AS tags FROM pt")
def s12_tagged_file(spark, sf):
    name = F.split("expansion", " ")
    tags = F.concat(F.array(F.lit("O")), F.transform(name, lambda x, i: F.when(i == 0, "B-long").otherwise("I-long")), F.array(F.lit("O"), F.lit("B-short"), F.lit("O")))
    row = F.struct(F.col("article_id").alias("id"), F.concat(F.array(F.lit("The")), name, F.array(F.lit("("), "acronym", F.lit(")"))).alias("tokens"), tags.alias("labels"))
    d = R.tagged_json(spark, wholes(parts(spark, sf), F.to_json(F.collect_list(row)), folder(spark, "tagged")))
    return d.select("article_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"))


# -- reports ------------------------------------------------------------------------------------------


SHARES = f"WITH {DICT}, sh AS (SELECT acronym, expansion, count(*) / sum(count(*)) OVER (PARTITION BY acronym) AS confidence FROM dict GROUP BY 1, 2)"


@query(f"{SHARES} SELECT 'svm' AS expander, 'f' AS fold, dict.article_id, dict.acronym, sh.expansion, round(confidence, 8) AS confidence FROM dict JOIN sh USING (acronym)")
def s19_k4_confidences_file(spark, sf):
    d, path = dictionary(spark, sf), folder(spark, "confidences")
    n = d.groupBy("acronym", "expansion").agg(F.count("*").alias("n"))
    share = n.join(d.groupBy("acronym").agg(F.count("*").alias("all")), "acronym").select("acronym", "expansion", (F.col("n") / F.col("all")).alias("c"))
    options = share.groupBy("acronym").agg(F.map_from_entries(F.collect_list(F.struct("expansion", "c"))).alias("options"))
    K.confidences_csv(d.select(F.lit("f").alias("fold"), "article_id", "acronym").join(options, "acronym"), path)
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, f in enumerate(x for x in fs.listStatus(made(path)) if x.getPath().getName().startswith("part-")):
        fs.mkdirs(made(f"{path}-read/part={k}"))
        fs.rename(f.getPath(), made(f"{path}-read/part={k}/confidences_svm.csv"))
    return R.confidences_csv(spark, f"{path}-read").select("expander", "fold", "article_id", "acronym", "expansion", F.round("confidence", 8).alias("confidence"))


@query(f"{CHOICES} SELECT 'f' || \"order\" % 5 AS fold, article_id, acronym, actual, predicted, round(confidence, 8) AS confidence, success FROM ch")
def k2_quality_file(spark, sf):
    path = folder(spark, "quality")
    fold = F.concat(F.lit("f"), F.substring_index("article_id", "-", 1).cast("long") % 5)
    K.quality_csv(chosen(spark, sf).withColumn("fold", fold), path)
    back = spark.read.csv(path, header=True, escape='"', schema="fold string, article_id string, acronym string, actual string, predicted string, confidence double, success boolean")
    return back.withColumn("confidence", F.round("confidence", 8))


@query(f"{CHOICES}, r AS (SELECT acronym, count(*) AS n, round(avg(success::INT::DOUBLE), 8) AS accuracy FROM ch GROUP BY 1) SELECT 'one' AS run, * FROM r UNION ALL SELECT 'two', * FROM r")
def k2_report_appended(spark, sf):
    """Two runs' reports in one file."""
    path, r = folder(spark, "report"), M.accuracies(chosen(spark, sf), ["acronym"]).select("acronym", "n", "accuracy")
    for run in ("one", "two"):
        K.report_csv(r.withColumn("run", F.lit(run)), path)
    return spark.read.csv(path, header=True, escape='"', schema="acronym string, n long, accuracy double, run string").select("run", "acronym", "n", F.round("accuracy", 8).alias("accuracy"))


@query(f"WITH {DICT} SELECT article_id AS id, expansion AS prediction FROM dict")
def k5_predictions_file(spark, sf):
    path = folder(spark, "predictions")
    K.predictions_json(dictionary(spark, sf), path)
    return spark.read.schema("id string, prediction string").json(path)


@query(f"{CHOICES} SELECT article_id, acronym, predicted AS expansion, round(confidence, 8) AS confidence, 'out_expander' AS module FROM ch WHERE predicted IS NOT NULL")
def k6_responses(spark, sf):
    """What a service would answer, taken apart again."""
    c = chosen(spark, sf).where("predicted is not null").select("article_id", "acronym", F.col("predicted").alias("expansion"), "confidence", F.lit("out_expander").alias("module"))
    entry = "array<struct<acronym: string, expansion: string, confidence: double, module: string>>"
    back = K.response_json(c).select("article_id", F.explode(F.from_json("response", entry)).alias("e")).select("article_id", "e.*")
    return back.withColumn("confidence", F.round("confidence", 8))


@query(f"WITH {DICT} SELECT acronym, count(*) AS articles, count(DISTINCT expansion) AS options FROM dict GROUP BY 1")
def k7_train_stats_file(spark, sf):
    path = folder(spark, "stats")
    K.train_stats_csv(dictionary(spark, sf).groupBy("acronym").agg(F.count("*").alias("articles"), F.countDistinct("expansion").alias("options")), path)
    return spark.read.csv(path, header=True, schema="acronym string, articles long, options long")
