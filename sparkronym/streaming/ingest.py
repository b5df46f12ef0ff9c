"""Continuous building of the dictionary: articles as they come, each article once.

An id is taken the first time that it comes, and never again: which ids have come is state
by id that no watermark ends and that a restart finds in the checkpoint. It lives on the
executors' disks (RocksDB), dealt by id, so that it may be larger than memory; a batch
meets it only where its own ids are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkronym.operators.extract import extract
from sparkronym.shipping import ship

ARTICLES = "article_id string, raw_text string, ts timestamp"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_articles(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", per_batch).parquet(path)


class _FirstOnly(StatefulProcessor):
    """Of an id's rows the earliest (of equals the first by text), if the id hasn't come before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        if not self.seen.exists():
            self.seen.update((True,))
            yield every.sort_values(["ts", "raw_text"], na_position="last").head(1)[["article_id", "raw_text", "ts"]]

    def close(self) -> None:
        pass


def first_only(articles: DataFrame) -> DataFrame:
    """The stream's articles whose id hasn't come before, in this run or an earlier one; of several at once the earliest.

    Articles without an id are left out: nothing tells whether they came before."""
    spark = articles.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = articles.where("article_id is not null").select("article_id", "raw_text", "ts")
    return known.groupBy("article_id").transformWithStateInPandas(_FirstOnly(), ARTICLES, "Append", "None")


def pairs_stream(articles: DataFrame, rule: str = "schwartz_hearst") -> DataFrame:
    """Pairs of a stream of articles, each id once."""
    return extract(first_only(articles), rule)


def ingest(articles: DataFrame, out: str, checkpoint: str, rule: str = "schwartz_hearst") -> StreamingQuery:
    """Appends pairs to a table. A batch that is run again after a failure replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return pairs_stream(articles, rule).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by window and type; late ones count until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
