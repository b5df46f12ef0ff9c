"""What the operators of this subpackage share: intermediate tables in the shared
folder, and words."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkronym.shipping import ship  # noqa: F401 the operators import it from here

#: What separates words, in every operator here, as a class for Java's, RE2's and Python's patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it
    is unset (tests, one machine) a folder of our own."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="sparkronym-")
    return _own


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one run of an operator, written to the shared folder.

    A written table cuts the lineage: when executors are lost, what was written need
    not be computed again. Tables that the returned frame doesn't read are dropped by
    the operator as soon as they are of no more use; the others go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))
            self.names = [x for x in self.names if x != name]

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 the session has ended; the folder belongs to it
            pass


def names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(scratch: Scratch, df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with _idx, the row's place from 0 among those of its key in the given order, and
    _total, the rows of the key. Nulls come first; rows that tie get places in any order.

    The rows are sorted by ranges of (key, order), so that a key of many rows is spread over
    many tasks, and written; places follow from how many rows of the key each task before
    has, a table of a row for each task and key."""
    cols = df.columns
    ranged = df.repartitionByRange(*(F.asc_nulls_first(c) for c in (key, *order))).sortWithinPartitions(*(F.asc_nulls_first(c) for c in (key, *order)))
    ranged = scratch.save(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    w = Window.partitionBy("_key")
    parts = ranged.groupBy(F.col(key).alias("_key"), F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_key", "_part", (before - F.col("_first")).alias("_add"), F.sum("_n").over(w).alias("_total"))
    out = ranged.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.shiftright("_at", 33) == F.col("_part")))
    return out.select(*cols, (F.col("_at") + F.col("_add")).alias("_idx"), "_total")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar(df: DataFrame):
    """The one value of an aggregate's one row."""
    return df.first()[0]
