import json

from pyspark.sql import functions as F

from sparkronym.functions import text as X
from sparkronym.operators import expanders as E
from sparkronym.operators import links as L
from sparkronym.operators.extract import extract
from sparkronym.sources import readers as R
from sparkronym.sources import sinks as K
from sparkronym.streaming import ingest as S


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_bioc(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<collection><document><id>7</id><passage><infon key="type">title</infon><text>Heat shock protein (HSP)</text>'
        '<annotation id="L1"><infon key="type">ABBR</infon><infon key="ABBR">LongForm</infon><text>Heat shock protein</text></annotation>'
        '<annotation id="S1"><infon key="type">ABBR</infon><infon key="ABBR">ShortForm</infon><text>HSP</text></annotation>'
        '<relation id="R1"><infon key="type">ABBR</infon><node refid="L1" role="LongForm"/><node refid="S1" role="ShortForm"/></relation></passage>'
        '<passage><infon key="type">abstract</infon><text>More.</text></passage></document></collection>'
    )
    texts, gold = R.bioc(spark, str(tmp_path / "a.xml"))
    assert got(texts) == [("7", "Heat shock protein (HSP)\nMore.")]
    assert got(gold) == [("7", "HSP", "Heat shock protein", True)]


def test_arff(spark, tmp_path):
    (tmp_path / "arff").mkdir()
    (tmp_path / "arff" / "aa_pmids.arff").write_text('@RELATION aa\n@DATA\n1,"We use <e>AA</e> here",M1\n2,"No <e>AA</e>",M2\n')
    (tmp_path / "senses.txt").write_text("AA\tAAM1\tAmino Acid\nAA\tAAM2\tAlcoholics Anonymous\n")
    texts, dictionary = R.arff(spark, str(tmp_path / "arff"), str(tmp_path / "senses.txt"))
    assert got(texts) == [("1", "We use AA here"), ("2", "No AA")]
    assert got(dictionary.select("acronym", "expansion", "article_id")) == [("AA", "Alcoholics Anonymous", "2"), ("AA", "Amino Acid", "1")]


def test_coded_texts(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "5.txt").write_text("we use AAM1 here")
    (tmp_path / "senses.txt").write_text("AA\tAAM1\tAmino Acid\n")
    texts, dictionary = R.coded_texts(spark, str(tmp_path / "t"), str(tmp_path / "senses.txt"))
    assert got(texts) == [("5", "we use Amino_Acid here")]
    assert got(dictionary.select("acronym", "expansion", "article_id")) == [("AA", "Amino Acid", "5")]


def test_sgml(spark, tmp_path):
    (tmp_path / "r.sgm").write_text('<REUTERS TOPICS="YES" NEWID="3"><TEXT><TITLE>HEAD</TITLE><BODY>One\ntwo.</BODY></TEXT></REUTERS>')
    assert got(R.sgml_news(spark, str(tmp_path / "r.sgm"))) == [("3", "HEAD\nOne two.")]


def test_json(spark, tmp_path):
    one = {"full_form": "a b", "link": "l", "content": "c", "possibilities": [{"full_form": "a c", "link": "m", "content": "d"}]}
    (tmp_path / "d.json").write_text(json.dumps({"AB": one, "X": {**one, "possibilities": []}}))
    assert got(R.disambiguation_json(spark, str(tmp_path / "d.json")).select("acronym", "expansion", "split")) == [("AB", "a b", "train"), ("AB", "a c", "test")]
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "tokens": ["see", "AB", "."], "acronym": 1, "expansion": "a b"}]))
    texts, dictionary = R.token_json(spark, str(tmp_path / "t.json"))
    assert got(texts) == [("1", "see a_b .")]
    assert got(dictionary.select("acronym", "expansion")) == [("AB", "a b")]
    (tmp_path / "g.json").write_text(json.dumps([{"id": "1", "tokens": ["AB"], "labels": ["B-short"]}]))
    assert got(R.tagged_json(spark, str(tmp_path / "g.json"))) == [("1", ["AB"], ["B-short"])]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,id,inside,outside\nT,9,"AB;A b\nbad line","CD;C d"\n')
    assert got(R.annotations_csv(spark, str(tmp_path / "a.csv"))) == [("9", "AB", "a b", True), ("9", "CD", "c d", False)]


def test_wiki_and_files(spark, tmp_path):
    (tmp_path / "w" / "AA").mkdir(parents=True)
    (tmp_path / "w" / "AA" / "wiki_00").write_text('<doc id="1" url="u" title="T">\nBody\n</doc>\n<doc id="2" url="v" title="S">Other</doc>')
    ids = spark.createDataFrame([("2",)], "article_id string")
    assert got(R.wiki_wanted(spark, str(tmp_path / "w"), ids)) == [("2", "v", "S", "Other")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_text("<html><head><title>x</title></head><body><p>Hi <b>you</b></p><script>no</script></body></html>")
    (tmp_path / "h" / "b.txt").write_text("plain")
    assert got(R.html_files(spark, str(tmp_path / "h"))) == [("a.html", "Hi you"), ("b.txt", "plain")]


def test_science(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("the red-shift surveys")
    (tmp_path / "s.csv").write_text("1,RS,3,red shift\n1,XX,4,quite other thing\n")
    _, gold = R.science_csv(spark, str(tmp_path / "s.csv"), str(tmp_path / "t"))
    assert got(gold) == [("1", "RS", "red shift", True), ("1", "XX", "quite other thing", False)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("f", "1", "AB", {"a b": 0.5, "a c": 0.25})], "fold string, article_id string, acronym string, options map<string,double>")
    K.confidences_csv(d.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    part.rename(tmp_path / "confidences_svm.csv")
    assert got(R.confidences_csv(spark, str(tmp_path / "confidences_svm.csv"))) == [("svm", "f", "1", "AB", "a b", 0.5), ("svm", "f", "1", "AB", "a c", 0.25)]
    K.stored_map(d, str(tmp_path / "m"), "article_id")
    assert R.stored_map(spark, str(tmp_path / "m")).count() == 1
    for _ in range(2):
        K.report_csv(d.select("fold"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    p = spark.createDataFrame([("1", "AB", "a b", 1.0, "in_expander")], "article_id string, acronym string, expansion string, confidence double, module string")
    K.predictions_json(p, str(tmp_path / "p"))
    assert got(spark.read.json(str(tmp_path / "p"))) == [("1", "a b")]
    assert json.loads(K.response_json(p).first()["response"])[0]["expansion"] == "a b"


def test_links(spark):
    pages = spark.createDataFrame(
        [("1", "http://x.org/d/a.html", '<abbr title="a b">AB</abbr> <a href="b.html#t">CD</a> <a href="#n">EF</a>'), ("2", "http://x.org/d/b.html", "<p>The Common Dog (CD) barks.</p>")],
        "article_id string, url string, html string",
    )
    found = L.links(pages)
    assert got(L.followable(found).select("text", "target")) == [("CD", "http://x.org/d/b.html")]
    open_ = spark.createDataFrame([("1", "AB"), ("1", "CD"), ("1", "EF")], "article_id string, acronym string")
    assert got(L.follow(open_, found, pages)) == [("1", "AB", "a b"), ("1", "CD", "Common Dog")]


def test_errors_are_rows(spark):
    def rule(text):
        if "bad" in text:
            raise ValueError("no")
        return {"AB": "a b"}

    a = spark.createDataFrame([("1", "bad"), ("2", "good"), ("3", None)], "article_id string, raw_text string")
    assert got(extract(a, rule).select("article_id", "acronym", F.col("error").isNotNull())) == sorted([("1", None, True), ("2", "AB", False), ("3", "AB", False)], key=str)


def test_streaming(spark, tmp_path):
    rows = [("1", "A relational database system (RDS) runs.", "2024-01-01 00:00:00"), ("1", "A relational database system (RDS) runs.", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "article_id string, raw_text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    q = S.ingest(S.read_articles(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert got(spark.read.parquet(str(tmp_path / "out")).select("article_id", "acronym", "expansion")) == [("1", "RDS", "relational database system")]


def test_fitted_models(spark):
    d = spark.createDataFrame([("AB", "a b", "1", 1), ("AB", "a b", "2", 2), ("AB", "a c", "3", 3), ("AB", "a c", "4", 4)], "acronym string, expansion string, article_id string, pos long")
    v = spark.createDataFrame([("1", "x", 1.0), ("2", "x", 1.0), ("3", "y", 1.0), ("4", "y", 1.0), ("t", "y", 1.0)], "article_id string, term string, weight double")
    m = spark.createDataFrame([("t", "AB")], "article_id string, acronym string")
    for fn in (E.logistic, E.svm, E.random_forest, E.cosine_scores):
        assert E.choose(fn(m, d, v, v)).first()["expansion"] == "a c", fn


def test_tags_and_text(spark):
    r = spark.createDataFrame([(["B-x", "L-x", "U-y", "O"], ["x", "x", "O", "y"])], "a array<string>, b array<string>")
    out = r.select(X.convert_tags("a", "BIOUL").alias("a"), X.convert_tags("b", "BIOless").alias("b")).first()
    assert out["a"] == ["B-x", "I-x", "B-y", "O"] and out["b"] == ["B-x", "I-x", "O", "B-y"]
