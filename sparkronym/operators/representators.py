"""Vectors of texts and terms. Sparse ones are tables (id, term, weight), dense ones (id, vector array<double>).

Terms stay rows, so that products of vectors are joins and sums on the term; dense
vectors come from Spark ML models or from any function registered here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkronym.functions.text import col
from sparkronym.operators.topics import lda
from sparkronym.storage import Steps


def term_counts(docs: DataFrame, tokens_col: str = "tokens", id_col: str = "article_id") -> DataFrame:
    return docs.select(id_col, F.explode(tokens_col).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, tokens_col: str = "tokens", id_col: str = "article_id") -> DataFrame:
    """term -> documents with it, occurrences, and the largest number of occurrences in one document."""
    return term_counts(docs, tokens_col, id_col).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def context_vectors(docs: DataFrame, train: DataFrame | None = None, concept_col: str | None = None, tokenise: Callable = None) -> DataFrame:
    """(article_id, term, weight): counts over the training vocabulary, divided by the largest count.

    docs: article_id and raw_text, with a concept (an acronym) that is removed from the
    text as a substring before words are counted."""
    from sparkronym.functions.text import tokens

    tokenise = tokenise or tokens
    text = F.col("raw_text") if concept_col is None else F.replace(F.col("raw_text"), F.col(concept_col), F.lit(""))
    keys = ["article_id"] + ([concept_col] if concept_col else [])
    tf = docs.select(*keys, F.explode(tokenise(text)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    source = tf if train is None else train.select("article_id", F.explode(tokenise(F.col("raw_text"))).alias("term")).groupBy("article_id", "term").agg(F.count("*").alias("tf"))
    if train is not None:
        tf = tf.join(source.select("term").distinct(), "term", "left_semi")
    top = source.agg(F.max("tf").alias("top"))
    return tf.crossJoin(F.broadcast(top)).select(*keys, "term", (F.col("tf") / F.col("top")).alias("weight"))  # one row


def n_grams(tokens_col: str, low: int = 1, high: int = 1):
    """All runs of low to high tokens, joined by spaces."""
    t = col(tokens_col)
    parts, grams = [], t
    for n in range(1, high + 1):
        if n > 1:  # each run of n - 1 tokens and the token after it
            grams = F.zip_with(F.slice(grams, 1, F.greatest(F.lit(0), F.size(t) - n + 1)), F.slice(t, n, F.greatest(F.lit(0), F.size(t) - n + 1)), lambda x, y: F.concat_ws(" ", x, y))
        if n >= low:
            parts.append(grams)
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def tfidf(docs: DataFrame, train: DataFrame | None = None, max_features: int | str | None = None, max_df: float = 1.0, min_df: float = 0, ngram: tuple[int, int] = (1, 1), stop_words: list[str] = (), id_col: str = "article_id") -> DataFrame:
    """(id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), rows of length 1.

    train: where document frequencies are from (docs if not given). max_features: that
    many terms of the largest corpus frequency (ties by term), or "log" for int(ln(distinct
    words)) + 1. min_df and max_df: shares up to 1, numbers of documents above.

    Where no terms are left out by these, documents stay in blocks, and only a block's different terms are shuffled."""
    if train is None and max_features is None and max_df == 1.0 and min_df == 0:
        return _tfidf_of_blocks(docs.select(id_col, "tokens"), ngram, list(stop_words), id_col)
    base = docs if train is None else train
    make = lambda d: d.select(id_col, F.filter(n_grams("tokens", *ngram), lambda t: ~t.isin(list(stop_words))).alias("tokens") if stop_words else n_grams("tokens", *ngram).alias("tokens"))
    tf_train = term_counts(make(base), id_col=id_col)
    terms = tf_train.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    n = base.agg(F.count("*").alias("n"))
    terms = terms.crossJoin(F.broadcast(n))  # one row
    at_least = F.lit(float(min_df)) if min_df > 1 else F.col("n") * float(min_df)
    at_most = F.lit(float(max_df)) if max_df > 1 else F.col("n") * float(max_df)
    terms = terms.where((F.col("df") >= at_least) & (F.col("df") <= at_most))
    if max_features == "log":
        total = terms.count()
        import math

        max_features = int(math.log(max(1, total))) + 1
    if max_features is not None:
        terms = terms.orderBy(F.desc("cf"), "term").limit(int(max_features))
    idf = terms.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = tf_train if train is None else term_counts(make(docs), id_col=id_col)
    raw = tf.join(idf, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def tfidf_of_texts(train: DataFrame, *others: DataFrame, tokenise: Callable | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """tfidf() of tables of texts (article_id, raw_text), by the document frequencies of the first, each different text once.

    For each table (article_id, same), whose names are 128 bits of the text's SHA-256, and (same, bag array<struct<term, weight>>),
    see expanders.named(). Texts of an article are one text; texts without a known token have no bag."""
    from sparkronym.functions.text import tokens

    tokenise, steps = tokenise or tokens, Steps(train.sparkSession, "texts")

    def counted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        whole = df.groupBy("article_id").agg(F.array_sort(F.collect_list("raw_text")).alias("texts"))
        whole = steps.cut(whole.select("article_id", F.unhex(F.substring(F.sha2(F.to_json("texts"), 256), 1, 32)).alias("same"), "texts"))
        each = whole.groupBy("same").agg(F.first("texts").alias("texts"), F.count("*").alias("articles"))
        words = each.select("same", "articles", F.explode(F.flatten(F.transform("texts", lambda x: tokenise(x)))).alias("term")).where("term is not null")
        return whole.select("article_id", "same"), steps.cut(words.groupBy("same", "articles", "term").agg(F.count("*").alias("tf")))

    tables = [counted(df) for df in (train, *others)]
    n = train.count()
    idf = tables[0][1].groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.sum("articles"))) + 1).alias("idf"))

    def weighed(tf: DataFrame) -> DataFrame:
        raw = tf.join(idf, "term").groupBy("same").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w")))).alias("bag"))
        raw = raw.withColumn("norm", F.sqrt(F.aggregate("bag", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])))
        return steps.cut(raw.select("same", F.transform("bag", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("norm")).alias("weight"))).alias("bag")))

    return [(names, weighed(tf)) for names, tf in tables]


#: Tokens of a block, about.
BLOCK_TOKENS = 1_500_000


def _counted(docs: pa.Table, ngram: tuple[int, int], stop_words: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and terms of a block of documents (id, data, lengths), and places of an id and of a term with how often they meet."""
    def whole(column: pa.ChunkedArray) -> pa.Array:
        out = column.combine_chunks()
        return out if isinstance(out, pa.Array) else out.chunk(0)

    ids = whole(docs.column(0)).dictionary_encode("encode")
    lengths = whole(docs.column(2))
    n, sizes = np.asarray(lengths.value_lengths()), np.asarray(lengths.flatten())
    data = np.frombuffer(b"".join(x.as_py() for x in docs.column(1)), np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    t = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    row = np.repeat(np.arange(len(docs)), n)
    grams, rows = [], []
    for k in range(ngram[0], ngram[1] + 1):
        left = len(t) - k + 1
        if left <= 0:
            break
        here = row[:left] == row[k - 1 :]
        g = t if k == 1 else pc.binary_join_element_wise(*(t.slice(i, left) for i in range(k)), pa.scalar(" ", pa.large_string()))
        grams.append(g.filter(pa.array(here)))
        rows.append(row[:left][here])
    g, row = (pa.concat_arrays(grams), np.concatenate(rows)) if grams else (pa.array([], pa.large_string()), np.zeros(0, int))
    if stop_words:
        keep = ~np.asarray(pc.is_in(g, value_set=pa.array(stop_words, pa.large_string())))
        g, row = g.filter(pa.array(keep)), row[keep]
    g = g.dictionary_encode()
    pairs, tf = np.unique(np.asarray(ids.indices)[row].astype(np.int64) * max(1, len(g.dictionary)) + np.asarray(g.indices), return_counts=True)
    return ids.dictionary, g.dictionary, *np.divmod(pairs, max(1, len(g.dictionary))), tf


def _tfidf_of_blocks(docs: DataFrame, ngram: tuple[int, int], stop_words: list[str], id_col: str) -> DataFrame:
    """A block says how many documents it has of each of its terms, and is told of those that other blocks have too."""
    from sparkronym.shipping import ship

    ship(docs.sparkSession)
    n, tokens = docs.agg(F.count("*"), F.sum(F.size(F.coalesce("tokens", F.array().cast("array<string>"))))).first()
    words = F.filter("tokens", lambda x: x.isNotNull())
    blocks = max(1, -(-(tokens or 0) // BLOCK_TOKENS))
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block")
    own = docs.where("size(tokens) > 0").select(F.col(id_col), F.array_join(words, "").cast("binary").alias("data"), F.transform(words, F.octet_length).alias("lengths"), block)

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, terms, _, term, _ = _counted(table, ngram, stop_words)
        return pa.table({"block": pa.array([key[0].as_py()] * len(terms), pa.int64()), "term": terms.cast(pa.string()), "n": pa.array(np.bincount(term, minlength=len(terms)), pa.int64())})

    def weigh(key: tuple[pa.Scalar, ...], table: pa.Table, others: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({id_col: table.column(id_col), "term": pa.array([], pa.string()), "weight": pa.array([], pa.float64())})
        ids, terms, row, term, tf = _counted(table, ngram, stop_words)
        df = np.bincount(term, minlength=len(terms))
        at = np.asarray(pc.index_in(others.column("term").cast(pa.large_string()), value_set=terms)).astype(int)
        df[at] = np.asarray(others.column("df"))
        w = tf * (np.log((1 + n) / (1 + df)) + 1)[term]
        norm = np.sqrt(np.bincount(row, w * w, len(ids)))
        return pa.table({id_col: ids.take(pa.array(row)), "term": terms.take(pa.array(term)).cast(pa.string()), "weight": pa.array(w / norm[row], pa.float64())})

    each = own.groupBy("block").applyInArrow(count, "block long, term string, n long")
    others = each.withColumn("df", F.sum("n").over(W.partitionBy("term"))).where("df > n").select("block", "term", "df")
    kind = docs.schema[id_col].dataType.simpleString()
    return own.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(weigh, f"`{id_col}` {kind}, term string, weight double")


def word_vectors(docs: DataFrame, size: int = 200, window: int = 8, epochs: int = 1, min_count: int = 1, seed: int = 0, negatives: int = 5) -> tuple[DataFrame, DataFrame]:
    """Vectors of tokens by skip-grams with negative sampling: of each block of documents (block, term, n, vector), and the
    table (term, vector) of their means by counts. No task and no driver has the vocabulary; see operators.skipgrams."""
    from sparkronym.operators import skipgrams

    return skipgrams.word_vectors(docs, size, window, epochs, min_count, seed, negatives)


def vector_sum(rows: DataFrame, keys: list[str], vector_col: str = "vector") -> DataFrame:
    """Sums of vectors by keys, element by element."""
    flat = rows.select(*keys, F.posexplode(vector_col).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def document_means(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The mean of its words' vectors for each document: what stands in for paragraph vectors, which Spark ML lacks."""
    from sparkronym.operators.skipgrams import sums

    return sums(docs, ["article_id"], vectors).select("article_id", F.transform("vector", lambda x: x / F.col("n")).alias("vector"))


def token_windows(docs: DataFrame, concept_col: str, window: int, tokens_col: str = "tokens") -> DataFrame:
    """(article_id, concept, at, tokens): up to window + 1 tokens on both sides of each occurrence of the concept."""
    t = F.col(tokens_col)
    at = docs.select("*", F.explode(F.filter(F.transform(t, lambda x, i: F.when(x == F.col(concept_col), i)), lambda i: i.isNotNull())).alias("at"))
    left = F.slice(t, F.greatest(F.lit(1), F.col("at") - window), F.least(F.col("at"), F.lit(window + 1)))
    right = F.slice(t, F.col("at") + 2, F.lit(window + 1))
    return at.select("article_id", F.col(concept_col).alias("concept"), "at", F.concat(left, right).alias("tokens"))


def window_vectors(docs: DataFrame, concept_col: str, vectors: DataFrame, window: int = 5) -> DataFrame:
    """(article_id, concept, vector): sums of word vectors in windows about the concept."""
    from sparkronym.operators.skipgrams import sums

    w = token_windows(docs, concept_col, window)
    return sums(w, ["article_id", "concept"], vectors).drop("n")


def term_vectors(text_vectors: DataFrame, gold: DataFrame) -> DataFrame:
    """(acronym, expansion, vector): sums of the vectors of the articles of each expansion."""
    return vector_sum(gold.join(text_vectors, "article_id"), ["acronym", "expansion"])


def concatenated(*parts: DataFrame, key: str = "article_id") -> DataFrame:
    """Dense vectors of several representators, one after the other; articles that all have."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(key, F.col("vector").alias(f"v{k}"))
        out = p if out is None else out.join(p, key)
    return out.select(key, F.concat(*(f"v{k}" for k in range(len(parts)))).alias("vector"))


def sentence_means(docs: DataFrame, encode: Callable[[list[str]], list[list[float]]], policy: str = "sentence") -> DataFrame:
    """(article_id, vector): the mean of what a given model makes of the text's sentences ("none": of the whole
    text; "simple": of pieces of 100 words). The model is the caller's: a function from texts to vectors."""
    import pandas as pd

    text = F.col("raw_text")
    if policy == "none":
        pieces = F.array(text)
    elif policy == "simple":
        w = F.split(text, r"\s+")
        pieces = F.transform(F.sequence(F.lit(1), F.size(w), F.lit(100)), lambda i: F.array_join(F.slice(w, i, 100), " "))
    else:
        pieces = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")

    def run(s):
        return pd.Series([list(map(float, v)) for v in encode(s.tolist())])

    vectors = F.pandas_udf(run, "array<double>")
    rows = docs.select("article_id", F.explode(pieces).alias("piece")).select("article_id", vectors("piece").alias("vector"))
    n = rows.groupBy("article_id").agg(F.count("*").alias("n"))
    return vector_sum(rows, ["article_id"]).join(n, "article_id").select("article_id", F.transform("vector", lambda x: x / F.col("n")).alias("vector"))


#: Extension surface: representators by name.
REGISTRY: dict[str, Callable] = {
    "document_context_vector": context_vectors, "tfidf": tfidf, "lda": lda, "doc2vec": word_vectors, "sbe_text": window_vectors, "sbert": sentence_means,
    "concat": concatenated, "uad": window_vectors, "text_to_term": term_vectors,
}
