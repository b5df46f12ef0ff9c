"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

1. toxicity: documents that score 0.5 or more go;
2. exact dedup: of equal texts that of the smallest doc_id stays;
3. n-gram Jaccard join: of documents linked at a similarity of 0.8 of five-word
   shingles, one of each component stays;
4. mixing: documents as often as the entropy-balanced mix takes them;
5. byte-level BPE: the token ids of each row, with digests of them and of what they decode to.

Every stage takes what its predecessor kept, and whole texts. Rows that share a doc_id,
null too, are told apart by their texts; rows that repeat doc_id and text are reduced to
one by the second stage, and the fourth repeats rows on purpose. A null text counts as
empty: it is scored with the rate of toxic rows, is a copy of other empty texts, is
linked with nothing, and has no tokens. An empty table gives an empty result. Further
columns of documents, whatever their names, stay through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkronym.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from sparkronym.llm.common import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *bpe.public(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("byte-level BPE", tokens)]

#: The first stage is a trained network, the fourth a numerical solution with rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
