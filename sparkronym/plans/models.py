"""Models and vectors that are fitted once: kept under a fingerprint of what they were fitted on and how.

A model is written under a name of its own and then committed by its manifest, a small
file that is renamed into place. A write that ended half-way has no manifest and is never
read; another that commits first wins. Data, fold or parameters that differ in anything
give another fingerprint, so that the model is fitted anew.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(data: DataFrame, fold: object = None, **params) -> str:
    """Of a table's columns and rows, in any order, with a fold and parameters.

    Two sums of row hashes and the number of rows are one aggregation, however many rows there are. Repeated
    rows count; a null differs from an empty value. Parameters are by name, and must be what JSON can hold."""
    columns = sorted(data.columns)
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"h{k}") for k in range(2)]
    got = data.select(*columns).agg(F.count("*").cast("string").alias("n"), *sums).first()
    of = [sorted(data.dtypes), list(got), fold, sorted(params.items())]
    return hashlib.sha256(json.dumps(of, sort_keys=True).encode()).hexdigest()


class ModelStore:
    """Models in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, kind: str, key: str) -> str:
        return f"{self.root}/{kind}-{key}.json"

    def load(self, kind: str, key: str) -> dict | None:
        """The model's parts by name, or None if none was committed."""
        path = self._path(self._manifest(kind, key))
        if not self._fs.exists(path):
            return None
        said = json.loads("\n".join(r["value"] for r in self.spark.read.text(self._manifest(kind, key)).collect()))
        out = {}
        for name, part in said["parts"].items():
            where = f"{self.root}/{said['folder']}/{name}"
            if part["class"] is None:
                out[name] = self.spark.read.schema(part["schema"]).parquet(where)
            else:
                module, _, cls = part["class"].rpartition(".")
                out[name] = getattr(importlib.import_module(module), cls).load(where)
        return out

    def save(self, kind: str, key: str, parts: Mapping) -> None:
        """Writes a model's parts, tables or fitted models of Spark ML, and commits them if no other has been meanwhile."""
        folder, said = f"{kind}-{key[:16]}-{uuid.uuid4().hex}", {}
        for name, part in parts.items():
            where = f"{self.root}/{folder}/{name}"
            if isinstance(part, DataFrame):
                part.write.option("compression", "zstd").parquet(where)
                said[name] = {"class": None, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)}
            else:
                part.save(where)
                said[name] = {"class": f"{type(part).__module__}.{type(part).__name__}"}
        draft = self._path(f"{self.root}/{folder}/manifest.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"folder": folder, "parts": said}).encode()))
        finally:
            out.close()
        done = self._path(self._manifest(kind, key))
        if self._fs.exists(done) or not self._fs.rename(draft, done):  # another has committed: its model is as good
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            if not self._fs.exists(done):
                raise OSError(f"{done}: can't be written")

    def get(self, kind: str, data: DataFrame, fit: Callable[[], Mapping], fold: object = None, **params) -> dict:
        """The parts of the model of this kind of these data, fold and parameters: read, or fitted, written and read."""
        key = fingerprint(data, fold, **params)
        found = self.load(kind, key)
        if found is None:
            self.save(kind, key, fit())
            found = self.load(kind, key)
        return found

    def clean(self) -> int:
        """Deletes folders that no manifest names (of writes that ended half-way); returns how many. Not while others write."""
        if not self._fs.exists(self._path(self.root)):
            return 0
        here = list(self._fs.listStatus(self._path(self.root)))
        named = set()
        for f in here:
            if f.isFile() and f.getPath().getName().endswith(".json"):
                named.add(json.loads("\n".join(r["value"] for r in self.spark.read.text(str(f.getPath())).collect()))["folder"])
        lost = [f.getPath() for f in here if f.isDirectory() and f.getPath().getName() not in named]
        for path in lost:
            self._fs.delete(path, True)
        return len(lost)
