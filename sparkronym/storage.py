"""Tables written on the way: in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. A folder of our own serves only one machine without that setting."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own = root = _own or "file://" + tempfile.mkdtemp(prefix="sparkronym-")
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 the session has ended; the folder belongs to it
        pass


class Steps:
    """Steps of one run, each a written table, so that plans don't grow and lost executors cost no earlier step.

    What a returned frame reads stays until the driver ends; drop() lets a step go before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(delete, spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *steps: DataFrame) -> None:
        for df in steps:
            delete(self.spark, self.paths.pop(id(df)))
