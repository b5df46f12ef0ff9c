"""Gives this package to Python workers, which may not have it on their path."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="sparkronym-zip-")  # the driver's own: executors get the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{top.name}-{uuid.uuid4().hex[:8]}.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
