"""Whole plans: expanding articles end to end, building a corpus, and benchmarks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkronym.functions.text import apply_pairs, expansion_token, tokens
from sparkronym.operators import dictionary as D
from sparkronym.operators import expanders as E
from sparkronym.operators import links as L
from sparkronym.operators import metrics as M
from sparkronym.operators import representators as R
from sparkronym.operators import splits as S
from sparkronym.operators.extract import extract
from sparkronym.storage import Steps


@dataclass(frozen=True)
class Corpus:
    """A training corpus: its articles and its dictionary."""

    articles: DataFrame
    dictionary: DataFrame


@dataclass(frozen=True)
class RunConfig:
    name: str = "run"
    rule: str = "schwartz_hearst"
    expander: str = "cossim"
    strict: bool = False
    args: dict = field(default_factory=dict)


def build_corpus(articles: DataFrame, rule: str = "schwartz_hearst") -> Corpus:
    """Pairs found in the articles, and the articles with each pair put to its expansion's token. A text is searched once,
    however many articles have it."""
    same = F.sha2("raw_text", 256)
    texts = articles.select("raw_text").distinct().select(same.alias("article_id"), "raw_text")
    said = D.drop_null(extract(texts, rule)).select("acronym", "expansion", F.col("article_id").alias("same"))
    found = articles.select(F.col("article_id").cast("string").alias("article_id"), same.alias("same")).join(said, "same").select("acronym", "expansion", "article_id")
    dictionary = found.withColumn("pos", F.xxhash64("article_id", "acronym"))
    pairs = found.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("acronym", "expansion"))).alias("pairs"))
    text = articles.select(F.col("article_id").cast("string").alias("article_id"), "raw_text").join(pairs, "article_id", "left")
    return Corpus(text.select("article_id", F.coalesce(apply_pairs("raw_text", "pairs"), "raw_text").alias("raw_text")), dictionary)


def precedence(inside: DataFrame, linked: DataFrame | None, outside: DataFrame) -> DataFrame:
    """(article_id, acronym, expansion, confidence, module): in-text first, then links, then the dictionary's choice."""
    keys = ["article_id", "acronym"]
    tag = lambda df, c: df.select(*keys, F.col("expansion").alias(c))
    out = inside.select(*keys, F.col("expansion").alias("i")).join(outside.select(*keys, F.col("expansion").alias("o"), "confidence"), keys, "left")
    out = out.join(tag(linked, "l"), keys, "left") if linked is not None else out.withColumn("l", F.lit(None).cast("string"))
    module = F.when(F.col("i").isNotNull(), "in_expander").when(F.col("l").isNotNull(), "link_follower").when(F.col("o").isNotNull(), "out_expander")
    best = F.coalesce("i", "l", "o")
    return out.select(*keys, best.alias("expansion"), F.when(module == "out_expander", F.col("confidence")).alias("confidence"), module.alias("module")).where("expansion is not null")


def expand(articles: DataFrame, corpus: Corpus, config: RunConfig = RunConfig(), pages: DataFrame | None = None) -> DataFrame:
    """What each acronym of each article stands for, sorted by article and acronym.

    strict: where no acronym of an article has rivals, its single-option answers are dropped. Without pages, which are an
    article's own, a text is expanded once, however many articles have it; it goes by 128 bits of its SHA-256."""
    if pages is not None:
        return _expanded(articles, corpus, config, pages).orderBy("article_id", "acronym")
    text, short = F.coalesce("raw_text", F.lit("")), lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    every = articles.select(F.col("article_id").cast("string").alias("article_id"), short(text).alias("text"), text.alias("raw_text"))
    steps = Steps(articles.sparkSession, "expand")
    texts = steps.cut(every.select("raw_text").distinct().select(short("raw_text").alias("text"), "raw_text"))
    # rows of one id are one article; null ids are none, and keep what is said in their texts
    lists = every.where("article_id is not null").groupBy("article_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    lists = lists.unionByName(every.where("article_id is null").select("article_id", F.array("text").alias("texts")))
    lists = lists.withColumn("same", F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(short(F.concat_ws(",", F.transform("texts", F.hex)))))
    lists = steps.cut(lists.select("article_id", "same", F.when(F.size("texts") > 1, F.col("texts")).alias("texts")))
    several = lists.where("texts is not null").groupBy("same").agg(F.first("texts").alias("texts")).select("same", F.explode("texts").alias("text")).join(texts, "text")
    whole = texts.select(F.col("text").alias("same"), "raw_text").unionByName(several.select("same", "raw_text"))
    found = steps.cut(_expanded(whole.select(F.hex("same").alias("article_id"), "raw_text"), corpus, config).withColumnRenamed("article_id", "same").withColumn("same", F.unhex("same")))
    out = lists.drop("texts").join(found, "same").where("article_id is not null or module = 'in_expander'")
    return out.drop("same").orderBy("article_id", "acronym")


def _expanded(articles: DataFrame, corpus: Corpus, config: RunConfig, pages: DataFrame | None = None) -> DataFrame:
    found = Steps(articles.sparkSession, "found").cut(extract(articles, config.rule, nulls=True).where("acronym is not null").select("article_id", "acronym", "expansion"))
    open_ = found.where("expansion is null").select("article_id", "acronym")
    linked = None
    if pages is not None:
        linked = L.follow(open_, L.links(pages), pages.select("url", "html"), config.rule)
        open_ = open_.join(linked, ["article_id", "acronym"], "left_anti")
    gated = D.gate(open_, corpus.dictionary)
    single = gated.where("n_options = 1").select("article_id", "acronym", "expansion", "confidence")
    if config.strict:
        single = single.join(gated.where("n_options > 1").select("article_id").distinct(), "article_id", "left_semi")
    rivals = gated.where("n_options > 1").select("article_id", "acronym")
    test = R.tfidf(articles.select(F.col("article_id").cast("string").alias("article_id"), tokens("raw_text").alias("tokens")).join(rivals.select("article_id").distinct(), "article_id", "left_semi"), corpus.articles.select("article_id", tokens("raw_text").alias("tokens")))
    train = R.tfidf(corpus.articles.select("article_id", tokens("raw_text").alias("tokens")))
    fn = E.REGISTRY[config.expander]
    scores = fn(rivals, corpus.dictionary, test, train, **config.args) if config.expander not in ("most_frequent",) else fn(rivals, corpus.dictionary)
    return precedence(found, linked, single.unionByName(E.choose(scores)))


def in_expansion_benchmark(articles: DataFrame, gold: DataFrame, rule: str) -> DataFrame:
    """Precision, recall and F1 of a rule's acronyms, expansions and pairs."""
    found = extract(articles, rule, nulls=True).where("error is null").select("article_id", "acronym", "expansion")
    return M.precision_recall(M.extraction_counts(gold, found))


def masked(articles: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test texts that don't give the answer away: each gold expansion's token becomes its acronym.

    (articles, gold) of what is left: a gold pair whose token isn't in the text (or has become another acronym of the
    same expansion, the first by text) can't be tested and goes, and with its last pair the article. Null texts go."""
    done = _masks(articles, gold)
    return done.select("article_id", F.col("s.text").alias("raw_text")), _kept(done)


def _kept(done: DataFrame, *cols: str) -> DataFrame:
    return done.select("article_id", *cols, F.explode("s.kept").alias("p")).select("article_id", *cols, "p.acronym", "p.expansion")


def _masks(articles: DataFrame, gold: DataFrame) -> DataFrame:
    pairs = gold.where("acronym is not null and expansion is not null").groupBy(F.col("article_id").cast("string").alias("id")).agg(F.array_sort(F.collect_set(F.struct("acronym", "expansion"))).alias("pairs"))
    j = articles.select(F.col("article_id").cast("string").alias("article_id"), "raw_text").join(pairs, F.col("article_id") == F.col("id")).where("raw_text is not null")
    none = F.filter("pairs", lambda p: F.lit(False))

    def step(s, p):
        token = expansion_token(p["expansion"])
        return F.struct(F.replace(s["text"], token, p["acronym"]).alias("text"), F.when(F.contains(s["text"], token), F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept"))

    return j.select("article_id", F.aggregate("pairs", F.struct(F.col("raw_text").alias("text"), none.alias("kept")), step).alias("s")).where(F.size("s.kept") > 0)


def out_expansion_benchmark(mentions: DataFrame, dictionary: DataFrame, folds: DataFrame, score: Callable[..., DataFrame], k: int, articles: DataFrame | None = None) -> DataFrame:
    """Accuracies by fold: mentions are the gold ones of test articles, and the dictionary is that of the others.

    score: (mentions, dictionary) -> scores. With articles, whose texts have expansions'
    tokens, score gets two tables of texts as well: the masked ones of the fold's test articles, and the others as they are.
    Folds run one after the other, and only their rows are left of them: the driver has the plan, and what is broadcast, of one.
    Texts are masked once, and each table is dealt to the folds once."""
    steps, out = Steps(mentions.sparkSession, "folds"), None
    ids = lambda df: df.withColumn("article_id", F.col("article_id").cast("string"))
    places = folds.where("fold is not null").groupBy("article_id").agg(F.collect_set("fold").alias("folds"))
    dealt = lambda df, at=places: steps.cut(df.join(at, "article_id"))
    test_of = lambda df, i: df.where(F.array_contains("folds", F.lit(i))).drop("folds")
    train_of = lambda df, i: df.where(F.exists("folds", lambda f: f != i)).drop("folds")
    d = dealt(dictionary)
    if articles is None:
        gold, kept = dealt(mentions), [d]
    else:
        hidden, whole = dealt(_masks(articles, mentions), ids(places)), dealt(articles)
        gold, kept = _kept(hidden, "folds"), [d, hidden, whole]
        hidden = hidden.select("article_id", F.col("s.text").alias("raw_text"), "folds")
    for i in range(k):
        test, train = test_of(gold, i), train_of(d, i)
        texts = [] if articles is None else [test_of(hidden, i), train_of(whole, i)]
        c = M.choices(test, E.choose(score(test.select("article_id", "acronym"), train, *texts)), D.options(train))
        row = steps.cut(M.accuracies(c).withColumn("fold", F.lit(i)))
        out = row if out is None else out.unionByName(row)
    steps.drop(*kept, *([gold] if articles is None else []))
    return out


def end_to_end_benchmark(articles: DataFrame, gold: DataFrame, corpus: Corpus, config: RunConfig = RunConfig()) -> DataFrame:
    """Gold, found and right pairs by module and in total."""
    found = expand(articles, corpus, config)
    j = gold.select("article_id", "acronym", F.col("expansion").alias("g")).join(found.select("article_id", "acronym", F.col("expansion").alias("p"), "module"), ["article_id", "acronym"], "full")
    from sparkronym.functions.similarity import similar

    rows = j.select(F.coalesce("module", F.lit("none")).alias("module"), F.col("g").isNotNull().alias("gold"), F.col("p").isNotNull().alias("found"), F.coalesce(similar("g", "p"), F.lit(False)).alias("right"))
    return M.module_counts(rows)
