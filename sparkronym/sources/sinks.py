"""Writers of tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored_map(df: DataFrame, path: str, key: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, sorted within files by a key so that lookups skip row groups."""
    (df.sortWithinPartitions(key) if key else df).write.mode(mode).parquet(path)


def quality_csv(choices: DataFrame, path: str) -> None:
    """Rows (fold, article_id, acronym, actual, predicted, confidence, success)."""
    choices.select("fold", "article_id", "acronym", "actual", "predicted", "confidence", "success").write.mode("overwrite").csv(path, header=True, escape='"')


def report_csv(report: DataFrame, path: str) -> None:
    """Appends a run's rows."""
    report.write.mode("append").csv(path, header=True, escape='"')


def report_jdbc(report: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Appends to a database's table, which is made if it isn't there."""
    report.write.mode("append").jdbc(url, table, properties=properties or {})


def confidences_csv(scores: DataFrame, path: str) -> None:
    """(fold, article_id, acronym, options map) with the map as JSON."""
    rows = scores.select("fold", F.col("article_id").alias("doc_id"), "acronym", F.to_json("options").alias("confidences_json_dict"))
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def predictions_json(predictions: DataFrame, path: str) -> None:
    predictions.select(F.col("article_id").alias("id"), F.col("expansion").alias("prediction")).write.mode("overwrite").json(path)


def response_json(predictions: DataFrame) -> DataFrame:
    """One JSON text for each article: what a service would answer."""
    entry = F.struct("acronym", "expansion", "confidence", "module")
    return predictions.groupBy("article_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("response"))


def train_stats_csv(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").csv(path, header=True)
